import random
import time

from quill.operators import geometry, parser

TEXT = """PERATURAN CONTOH
BAB I KETENTUAN UMUM
Pasal 1
Dalam peraturan ini yang dimaksud dengan contoh adalah contoh.
Pasal
2
(1) Pihak wajib menyampaikan:
a. laporan bulanan; dan
b. laporan tahunan.
(2) Laporan sebagaimana dimaksud pada
ayat (1), huruf a disampaikan tepat waktu.
- 3 -
| Kolom | Nilai |
|---|---|
| a. satu | 1 |
PENJELASAN
Pasal 1
Cukup jelas."""


def units(text=TEXT, **kw):
    return parser.parse("f1", [(1, text)], **kw)


def test_tree():
    rows = {r["node_id"]: r for r in units()}
    by = {(r["document_part"], r["unit_type"], r["label"]): r for r in rows.values()}
    pasal = by["normative", "pasal", "Pasal 2"]
    one, two = by["normative", "ayat", "(1)"], by["normative", "ayat", "(2)"]
    assert one["parent_id"] == pasal["node_id"] and two["previous_id"] == one["node_id"]
    assert by["normative", "huruf", "huruf b"]["parent_id"] == one["node_id"]
    assert two["display_text"] == "(2) Laporan sebagaimana dimaksud pada ayat (1), huruf a disampaikan tepat waktu."
    assert by["normative", "huruf", "huruf a"]["legal_path"] == {"bab": "BAB I", "pasal": "Pasal 2", "ayat": "(1)", "huruf": "huruf a"}
    assert "Pihak wajib menyampaikan" in by["normative", "huruf", "huruf a"]["retrieval_text"]


def test_parts_tables_lists():
    rows = units()
    table = next(r for r in rows if r["unit_type"] == "table")
    assert table["display_text"].count("\n") == 2 and table["legal_path"]["ayat"] == "(2)"
    assert not any(r["unit_type"] == "huruf" and "satu" in r["display_text"] for r in rows)
    explained = [r for r in rows if r["document_part"] == "explanation"]
    assert [r["unit_type"] for r in explained] == ["preamble", "pasal"] and explained[1]["parent_id"] is None
    lists = [r for r in rows if r["unit_type"] == "enumeration_aggregate"]
    assert len(lists) == 1 and len(lists[0]["source_block_ids"]) == 3 and lists[0]["display_text"].endswith("b. laporan tahunan.".replace("b.", "huruf b"))


def test_pages_and_long_lists():
    rows = parser.parse("f", [(1, "Pasal 1\nawal"), (2, "akhir\nPasal 2\nx")])
    first = next(r for r in rows if r["label"] == "Pasal 1")
    assert (first["page_start"], first["page_end"]) == (1, 2) and len(first["spans"]) == 2
    many = "Pasal 1\nIsi:\n" + "\n".join(f"{chr(97 + i)}. butir" for i in range(13))
    assert not any(r["unit_type"] == "enumeration_aggregate" for r in units(many))
    assert len({r["node_id"] for r in units()}) == len(units()) and parser.parse("f", []) == []


def test_outline():
    text = "I. KETENTUAN UMUM\n1. Pertama\na. butir a dari pertama\n1) rinci\nlanjutan\n(1) bukan ayat\nPasal 9\nisi"
    rows = units(text, outline=True)
    kinds = [(r["unit_type"], r["label"]) for r in rows if r["unit_type"] != "enumeration_aggregate"]
    assert kinds == [("section", "I. KETENTUAN UMUM"), ("point", "1"), ("subpoint", "a"), ("item", "1"), ("pasal", "Pasal 9")]
    assert "bukan ayat" in next(r for r in rows if r["unit_type"] == "item")["display_text"]


def test_window_parents_are_the_stacks(spark):
    import random

    from quill.operators import units as un

    rng = random.Random(1)
    rows = [(d, p + 1, rng.randrange(1, 6)) for d in range(30) for p in range(60)]
    got = {(r.doc_id, r.pos): r.parent_pos for r in un.parents(spark.createDataFrame(rows, "doc_id int, pos int, level int"), ["doc_id"], "pos", "level", 5).collect()}
    for d in range(30):
        stack = []
        for _, p, level in [r for r in rows if r[0] == d]:
            stack = [x for x in stack if x[1] < level]
            assert got[d, p] == (stack[-1][0] if stack else None)
            stack.append((p, level))


def test_geometry():
    items = [("1.", 227, 10), ("Satu", 255, 11), ("lanjut", 255, 24), ("2.", 227, 38), ("Dua", 255, 38), ("luar", 100, 52), ("- 7 -", 300, 60)]
    found = geometry.entries(geometry.page_lines([("a. " + t if t in ("Satu", "Dua") else t, x, y) for t, x, y in items if t not in ("1.", "2.")]))
    assert [e[0] for e in found] == ["a.", "a."]
    lines = geometry.page_lines([("a.", 227, 10), ("Satu", 255, 11), ("lanjut", 255, 24)])
    assert geometry.entries(lines)[0][1] == "a. Satu lanjut"
    assert geometry.block_text("a. Satu", geometry.entries(lines)) == "a. Satu lanjut" and geometry.block_text("x", []) is None


def test_a_units_length_does_not_slow_its_next_line():
    """Each line was compared with the whole text of its unit: 180 seconds for so many lines."""
    start = time.process_time()
    rows = parser.parse("f", [(1, "Pasal 1\n" + "pada ayat\n" * 8000)])
    assert len(rows) == 1 and rows[0]["display_text"] == "Pasal 1 " + " ".join(["pada ayat"] * 8000)
    assert time.process_time() - start < 10


def test_files_in_a_task_are_parsed_one_by_one(spark):
    pages = [(f"f{i}", p, f"Pasal {p}\n(1) isi {i}\na. satu\nb. dua") for i in range(40) for p in (3, 1, 2)] + [("none", 1, None)]
    got = parser.parse_files(spark.createDataFrame(pages, "file_id string, page_num int, text string")).collect()
    want = [r for i in range(40) for r in parser.parse(f"f{i}", [(p, f"Pasal {p}\n(1) isi {i}\na. satu\nb. dua") for p in (1, 2, 3)])]
    key = lambda r: (r["file_id"], r["unit_type"], r["node_id"])
    for a, b in zip(sorted((r.asDict(recursive=True) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a | {"spans": None} == b | {"spans": None}
        assert [tuple(s.values()) for s in a["spans"]] == b["spans"]


def test_items_by_height_give_the_lines_of_items(spark):
    rng = random.Random(5)
    items = [(f"f{rng.randrange(6)}", 1, rng.choice(["a.", "a. x", "kata", " ", "", None, "b  c", "12", "\x1c"]), rng.randrange(4) * 5.0, rng.choice([0.0, 1.0, 2.5, 4.0, 9.0, 14.0, 17.0, 30.0])) for _ in range(600)]
    got = geometry.page_entries(spark.createDataFrame(items, "file_id string, page_num int, text string, x double, y double")).collect()
    want = [(f, 1, *e) for f in sorted({i[0] for i in items}) for e in geometry.entries(geometry.page_lines([i[2:] for i in items if i[0] == f]))]
    assert sorted(map(tuple, got)) == sorted(want) and want
