import pytest

from quill.engine import Engine

ROWS = [
    (1, "f1", "b1", "Peraturan OJK tentang Perlindungan Konsumen", "12", "POJK", "Pasal 4", "(1)", None, "OJK", "primary_regulation", "Penyelenggara wajib menyampaikan laporan pengaduan konsumen paling lambat 20 hari sejak pengaduan diterima."),
    (2, "f1", "b2", "Peraturan OJK tentang Perlindungan Konsumen", "12", "POJK", "Pasal 5", None, None, "OJK", "primary_regulation", "Penyelenggara dilarang memberikan data konsumen kepada pihak lain tanpa persetujuan konsumen."),
    (3, "f2", "b3", "Peraturan Bank Indonesia tentang Uang Elektronik", "20", "PBI", "Pasal 4", "(1)", None, "BI", "primary_regulation", "Penerbit wajib memperoleh izin dari otoritas sebelum menerbitkan uang elektronik."),
    (4, "f3", "b4", "Tanya jawab perlindungan konsumen", "1", "FAQ", None, None, None, "OJK", "secondary_faq", "Pengaduan konsumen dapat disampaikan lewat telepon kapan saja oleh siapa pun."),
]


@pytest.fixture(scope="module")
def engine(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, file_id string, block_id string, title string, number string, regulation_type string, pasal string, ayat string, huruf string, issuer string, role string, text string")
    units = df.selectExpr("*", "1 AS page_start", "CAST(NULL AS string) AS angka")
    lexicon = {"issuers": [{"issuer": "OJK", "patterns": ["ojk"]}], "topics": [{"name": "complaints", "patterns": ["pengaduan"], "expansions": ["laporan pengaduan konsumen"]}]}
    with Engine(spark, units, lexicon) as e:
        yield e


def test_search_and_titles(engine):
    top = engine.search({1: "izin uang elektronik", 2: "data konsumen pihak lain"}).where("rank = 1").collect()
    assert {r.search_id: r.doc_id for r in top} == {1: 3, 2: 2}
    assert [r.file_id for r in engine.titles({1: "peraturan bank indonesia uang elektronik"}, 1).collect()] == ["f2"]


def test_answers_cite_or_refuse(engine):
    plans = engine.plans({1: "Berapa hari laporan pengaduan konsumen wajib disampaikan?", 2: "Bagaimana memelihara ikan hias?", 3: "Apa isi Pasal 5 POJK?"})
    got = {r.query_id: r for r in engine.answer(plans).collect()}
    assert got[1].status in ("answerable", "partial") and got[1].findings[0].block == "b1"
    assert got[2].status == "not_found" and got[2].findings == []
    assert all(f.block == "b2" for f in got[3].findings)
    assert {r.doc_id for r in engine.planned_search(plans).where("query_id = 3").collect()} == {2}
    assert engine.trace(plans).count() > 0


def test_batch_is_each_by_itself(engine):
    qs = {1: "laporan pengaduan konsumen", 2: "izin uang elektronik"}
    both = sorted(map(tuple, engine.planned_search(engine.plans(qs)).collect()))
    each = sorted(tuple(r) for k, q in qs.items() for r in engine.planned_search(engine.plans({k: q})).collect())
    assert both == each


def test_lookup(engine):
    assert [r.block_id for r in engine.document("f1").collect()] == ["b1", "b2"]
    assert engine.block("f2", "b3").first().doc_id == 3 and engine.block("f2", "none").count() == 0
    with pytest.raises(ValueError):
        Engine(engine.spark, engine.units.drop("title"))
