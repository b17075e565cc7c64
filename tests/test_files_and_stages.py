"""Documents from files, and stages that are lost half-way."""

import zipfile

import pytest
from pyspark.sql import functions as F

from pricelens.functions import specs
from pricelens.operators import retrieval, stages
from pricelens.sources import files

BODY = '<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'


def docx(path, *paragraphs):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", BODY.format("".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)))


def test_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.txt").write_text("Élan\n\nsuite", encoding="utf-8")
    (tmp_path / "in" / "b.TXT").write_bytes(b"\xff\xfe broken")
    (tmp_path / "c.docx").write_bytes(b"no archive")
    docx(tmp_path / "in" / "d.docx", "Un <w:tab/>".replace("<w:tab/>", "mot"), "x &amp; y " * 100)
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "f.csv").write_text("k,v")
    (tmp_path / "g.txt").write_text("x" * 5000)
    (tmp_path / "h.txt").write_text("")
    rows = files.read_documents(spark, str(tmp_path), 4000)
    got = {r.path.rsplit("/", 1)[1]: r for r in rows.collect()}
    assert len(got) == 7 and got["a.txt"].content == "Élan\n\nsuite" and got["f.csv"].content == "k,v"
    assert got["d.docx"].content == "Un mot\n\n" + "x & y " * 100
    why = {n: r.reason.split(":")[0] for n, r in got.items() if r.reason}
    assert why == {"b.TXT": "UnicodeDecodeError", "c.docx": "BadZipFile", "e.pdf": "no loader for this suffix", "g.txt": "larger than the bound"}
    assert files.quarantined(rows).count() == 4
    chunks = retrieval.chunked(rows.where("reason is null").select(F.xxhash64("path").alias("document_id"), "content"))
    assert chunks.where("length(content) <= 512").count() == chunks.count() == 5


def test_a_lost_stage_goes_on(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    seen = []

    def work(lot, lose=None):
        seen.append(lot.count())
        if lose is not None and len(seen) > lose:
            raise RuntimeError("lost")
        return lot.select("k", (F.col("x") + 1).alias("y"), F.when(F.col("k") % 10 == 3, "cannot").alias("reason"))

    stage = stages.Stage(spark, str(tmp_path / "s"), "k", "y long", attempts=2)
    with pytest.raises(RuntimeError):
        stage.run(rows, lambda lot: work(lot, 3), lots=6)
    half = stage.done().count()
    assert 0 < half < 90
    again = stages.Stage(spark, str(tmp_path / "s"), "k", "y long", attempts=2)
    assert again.run(rows, work, lots=4) == 100 - sum(seen[:3])  # the lost round's own lots, not those of this call
    assert sorted((int(r.k), r.y) for r in again.done().collect()) == [(k, 2 * k + 1) for k in range(100) if k % 10 != 3]
    assert {int(r.k): r.failures for r in again.quarantine().collect()} == {k: 1 for k in range(3, 100, 10)}
    more = rows.unionByName(spark.createDataFrame([(200, 0)], "k long, x long"))
    assert again.run(more, work) == 11 and again.run(more, work) == 0  # new rows and one more try, then nothing
    assert again.done().count() == 91 and {r.failures for r in again.quarantine().collect()} == {2}
    fixed = stages.Stage(spark, str(tmp_path / "s"), "k", "y long", attempts=3)
    assert fixed.run(more, lambda lot: work(lot).withColumn("reason", F.lit(None))) == 10 and fixed.quarantine().count() == 0 and fixed.done().count() == 101


def test_old_values(spark):
    cases = {"16 Go": "16gb", " 1 To SSD": "1tb ssd", "65 Watts": "65w", "15.6 pouces": '15.6"', "Sans OS": "freedos", "free-dos": "freedos", "2.0": "2", "512 GB": "512gb", None: ""}
    got = spark.createDataFrame([(k,) for k in cases], "v string").select("v", specs.old_value(F.col("v")).alias("o")).collect()
    assert {r.v: r.o for r in got} == cases
