from pyspark.sql import functions as F

from quill.functions import claims, legal, tables
from quill.functions import metadata as md
from quill.functions import text as t
from quill.operators import units as un


def one(spark, schema, values, *cols):
    return tuple(spark.createDataFrame([values], schema).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_dates_and_numbers(spark):
    d = [r[0] for r in spark.createDataFrame([("12/31/2020",), ("31/12/2020",), ("2020-12-31",), ("Jakarta, 5 Agustus 2021",), ("segera",), ("",), (None,)], "d string").select(md.normalize_date(F.col("d"))).collect()]
    assert d == ["2020-12-31", "2020-12-31", "2020-12-31", "2021-08-05", "segera", None, None]
    got = one(spark, "n string, t string", ("23\\6/PBI/2021", "x"), md.regulation_number(F.col("n"), F.col("t")), md.regulation_number(F.lit(None).cast("string"), F.lit("POJK No. 3 Tahun 2019 tentang")), md.series_key(F.lit("BI"), F.lit("PBI"), F.lit("23/6/PBI/2021")))
    assert got == ("23/6/pbi/2021", "3 tahun 2019", "bi-pbi-23-6-pbi")
    assert one(spark, "s string", ("ease-bi",), md.issuer(F.col("s"), F.lit("POJK")), md.issuer(F.col("s"), F.lit("UU"))) == ("OJK", "BI")


def test_records(spark):
    rows = [("ease-bi", "/a/b/rec.json", '{"title": "Peraturan  PBI Nomor 3 Tahun 2020", "status": "Dicabut", "supersedes": ["A", " B "], "year": 2020, "list_item": {"group_path": "x/y"}}'), ("o", "/p", "{}")]
    got = md.normalize_records(spark.createDataFrame(rows, "source string, path string, payload string")).collect()
    assert got[0].canonical_id == "bi-pbi-3-tahun-2020" and got[0].is_current is False and got[0].supersedes == ["A", "B"] and got[0].group_path == "x/y" and got[0].source_id == "rec"
    assert got[1].title == "" and got[1].number is None and got[1].issuer == "OJK"


def test_tables(spark):
    text = "| No | Nama | Nilai |\n|---|:---:|---|\n| 1. | Alfa  | 10 ; |\n| (2) | Beta | 20 |"
    rows, plain, flat, read = one(spark, "x string", (text,), tables.table_rows(F.col("x")), tables.table_text(F.col("x")), tables.table_rows(F.lit("a | b || c | d")), tables.readability(F.col("x")))
    assert rows == [["No", "Nama", "Nilai"], ["1.", "Alfa", "10"], ["(2)", "Beta", "20"]]
    assert plain == "No - Nama - Nilai; 1. - Alfa - 10; (2) Beta 20" and flat == [["a", "b"], ["c", "d"]]
    assert read.row_count == 3 and read.reasons == ["insufficient_natural_language"] or read.is_readable
    assert one(spark, "x string", ("tanpa tabel",), tables.table_rows(F.col("x")), tables.table_text(F.col("x"))) == ([], "tanpa tabel")
    assert one(spark, "x string", ("a ; ; b :; c ,d",), tables.list_text(F.col("x")))[0] == "a; b: c,d"


def test_text(spark):
    a, b = F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "xbcdy"))
    got = one(spark, "x string", ("Bank  Indonesia\t",), t.normalize_space(F.col("x")), t.longest_run(a, b), t.truncate_at_space(F.lit("satu dua tiga"), 7), t.contains_pattern(F.lit("aturan BI ini"), "bi"), t.contains_pattern(F.lit("bidang"), "bi"))
    assert got == ("Bank Indonesia", 3, "satu…", True, False)


def test_gates(spark):
    a = legal.alignment(F.col("q"), F.lit(""), F.col("c"))
    rows = [("Berapa batas laporan triwulan?", "laporan triwulan 10 hari"), ("Berapa batas laporan triwulan?", "laporan triwulan"), ("kapan promosi tidak boleh", "promo tidak boleh malam"), ("apa kewajiban promosi", "promo dianjurkan"), ("apa saja aturan", "apa pun")]
    got = [(r[0].accepted, r[0].reasons) for r in spark.createDataFrame(rows, "q string, c string").select(a).collect()]
    assert [g[0] for g in got] == [True, False, True, False, True] and got[1][1] == ["requested_value_not_supported"] and got[3][1] == ["predicate_not_supported:obligation"]
    c = one(spark, "x string", ("...Ketentuan ini meliputi:",), claims.complete(F.col("x")), claims.clean(F.col("x")), claims.noise_category(F.lit("Menimbang : bahwa")), claims.noise_penalty(F.lit("apa menimbang"), F.lit("consideration")))
    assert c == (False, "Ketentuan ini meliputi:", "consideration", 0.0)


def test_aliases(spark):
    units = spark.createDataFrame([("f", 1, "Penyedia Jasa Bayar wajib"), ("f", 2, "PJB dan Penyedia Jasa Bayar"), ("f", 3, "lain"), ("g", 1, "PJB")], "file string, pos int, text string")
    aliases = spark.createDataFrame([("f", "PJB", "Penyedia Jasa Bayar")], "file string, alias string, long_form string")
    got = {(r.file, r.pos): r.text for r in un.with_aliases(units, aliases, ["file"], ["pos"], "text").collect()}
    assert got == {("f", 1): "Penyedia Jasa Bayar wajib Istilah terkait: Penyedia Jasa Bayar (PJB).", ("f", 2): "PJB dan Penyedia Jasa Bayar", ("f", 3): "lain", ("g", 1): "PJB"}
