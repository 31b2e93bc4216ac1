"""Plans: questions to searches, and the execution of all searches at once."""
