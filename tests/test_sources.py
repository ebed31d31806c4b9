"""Readers, rewrites and checks."""

import gzip
import io
import os
import shutil
import subprocess
import sys
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lectern.sources import discard, files, schemas, shared_dir, sinks, stored


def _epub() -> bytes:
    page = lambda body: f"<html><head><title>t</title></head><body>{body}</body></html>"
    parts = {
        "META-INF/container.xml": '<container xmlns="urn:c"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>',
        "OPS/book.opf": '<package xmlns="urn:o"><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="text/b.xhtml" media-type="application/xhtml+xml"/><item id="i" href="img/i.png" media-type="image/png"/><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
        "OPS/a.xhtml": page('<h1 id="one">One</h1><p>first</p>'),
        "OPS/text/b.xhtml": page('<p>second</p><img src="../img/i.png" alt="pic"/>'),
        "OPS/img/i.png": "png",
        "OPS/toc.ncx": '<ncx xmlns="urn:n"><navMap><navPoint><navLabel><text>One</text></navLabel><content src="a.xhtml#one"/><navPoint><navLabel><text>Two</text></navLabel><content src="text/b.xhtml"/></navPoint></navPoint><navPoint><navLabel><text>Gone</text></navLabel><content src="c.xhtml"/></navPoint></navMap></ncx>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


@pytest.fixture
def library(tmp_path):
    (tmp_path / "good.epub").write_bytes(_epub())
    (tmp_path / "broken.epub").write_bytes(b"not a zip")
    (tmp_path / "note.txt").write_text("one\n\ntwo")
    return str(tmp_path)


def test_epubs(spark, library):
    books = files.files(spark, library, "epub")
    rows = files.epub_elements(books).orderBy("pos").collect()
    assert [(r.type, r.content or r.file, r.chapter, r.spine_index, r.mime) for r in rows] == [("text", "first", "One", 1, None), ("text", "second", "One", 2, None), ("image", "OPS/img/i.png", None, 2, "image/png")]
    assert [(r.idx, r.title, r.page, r.level, r.fragment) for r in files.epub_contents(books).orderBy("idx").collect()] == [(0, "One", 1, 0, "one"), (1, "Two", 2, 1, None)]
    assert [(r.name, r.n_bytes, r.mime) for r in files.epub_images(books).collect()] == [("OPS/img/i.png", 3, "image/png")]


def test_texts_and_kinds(spark, library):
    assert [r.content for r in files.text_documents(spark, f"{library}/*.txt").collect()] == ["one\n\ntwo"]
    assert files.supported(files.files(spark, library)).count() == 3
    with open(f"{library}/x.doc", "w") as f:
        f.write("x")
    with pytest.raises(PySparkException, match="not supported"):
        files.supported(files.files(spark, library)).collect()


def test_catalog_csv(spark, tmp_path):
    head = "Text#,Type,Issued,Title,Language,Authors,Subjects,LoCC,Bookshelves\n"
    rows = '1,Text,1971,"A ""quoted""\r\ntitle",en,"Some, One",x; y,,\n2,Sound,,Song,en,,,,\n3,Text,,Livre,fr,,,,\nbad,Text,,No number,en,,,,\n4,Text,,,en; fr,,,,Shelf\n'
    with gzip.open(f"{tmp_path}/c.csv.gz", "wt", newline="") as f:
        f.write(head + rows)
    found = files.catalog_csv(spark, str(tmp_path)).orderBy("catalog_id").collect()
    assert [(r.catalog_id, r.title, r.author, r.bookshelves) for r in found] == [(1, 'A "quoted" title', "Some, One", None), (4, "Untitled", None, "Shelf")]
    assert spark.range(1).select(files.subject_list(F.lit("x; y")).alias("v")).head()["v"] == ["x", "y"]


def test_images(spark):
    lines = ["page   num  type   width height color comp bpc  enc interp  object ID x-ppi y-ppi size ratio", "-" * 80, "   1     0 image    800   600  rgb     3   8  jpeg   no        10  0   150   150 45.2K 3.2%"]
    rows = files.listed_images(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.page, r.type, r.width, r.height, r.n_bytes) for r in rows] == [(1, "image", 800, 600, 46284)]
    data = b"\xff\xd8\xff\xe0..\x0f\xfd\x8f\xff" + b"\x89PNG\r\n\x1a\n" * 2 + b"GIF89aGIF87aGIF88a"
    found = spark.createDataFrame([(data,), (None,)], "c binary").select(files.marked_images(F.col("c")).alias("v")).collect()
    assert [tuple(r.v) for r in found] == [(1, 2, 2), (0, 0, 0)]
    images = spark.createDataFrame([(b"a", "image/png"), (b"a", "image/png"), (b"b", "odd")], "content binary, mime string")
    assert sorted(r.file for r in sinks.named_images(images).collect()) == ["3e23e8160039594a.bin", "ca978112ca1bbdca.png"]


def test_json(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"a": 1, "b": {"c": "x"}},\n {"a": 2}]')
    assert [(r.a, r.b and r.b.c) for r in files.json_array(spark, str(tmp_path)).collect()] == [(1, "x"), (2, None)]
    sinks.write_json(spark.range(2), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2


def test_appends_and_replacements(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.replace(spark.range(3), path)
    sinks.append(spark.range(2), path)
    assert spark.read.parquet(path).count() == 5
    sinks.replace(spark.range(1), path)
    assert spark.read.parquet(path).count() == 1


def test_rewrites(spark):
    rows = spark.createDataFrame([(1, 10, "a"), (2, None, "b"), (3, 30, None)], "id int, parent int, v string")
    assert sorted(r.id for r in sinks.cascade_deleted(rows, spark.createDataFrame([(10,)], "parent int"), "parent").collect()) == [2, 3]
    assert [(r.id, r.parent) for r in sinks.parents_unset(rows, spark.createDataFrame([(10,)], "parent int"), "parent").orderBy("id").collect()] == [(1, None), (2, None), (3, 30)]
    assert [r.v for r in sinks.updated_where(rows, F.col("v") == "a", {"v": F.lit("z")}).orderBy("id").collect()] == ["z", "b", None]
    parents = spark.createDataFrame([(10, "from"), (30, None)], "parent int, v string")
    assert [r.v for r in sinks.filled_from(rows, parents, "parent", "v").orderBy("id").collect()] == ["from", None, None]
    new = spark.createDataFrame([(3, 1, "new"), (4, 2, "later"), (4, 1, "first")], "id int, parent int, v string")
    assert [(r.id, r.v) for r in sinks.insert_new(rows, new, ["id"], ["parent"]).orderBy("id").collect()] == [(1, "a"), (2, "b"), (3, None), (4, "first")]
    ids = [r.key for r in sinks.with_ids(rows, ["id", "v"], "key").collect()]
    assert len(set(ids)) == 3 and ids == [r.key for r in sinks.with_ids(rows, ["id", "v"], "key").collect()]


def test_schemas_and_checks(spark):
    for name, ddl in schemas.SCHEMAS.items():
        columns = spark.createDataFrame([], ddl).columns
        assert set(schemas.KEYS[name]) <= set(columns) and set(schemas.UNIQUE.get(name, [])) <= set(columns)
    assert all(column in spark.createDataFrame([], schemas.SCHEMAS[t]).columns for t, column in schemas.DOMAINS)
    rows = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", None), ("3", "x")], "id string, kind string")
    assert [r.id for r in schemas.repeated_keys(rows, ["id"]).collect()] == ["1"]
    assert [r.kind for r in schemas.outside_domain(rows, "kind", ("a", "b")).collect()] == ["x"]
    parents = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [r.kind for r in schemas.orphans(rows, parents, "kind").collect()] == ["x"]


def test_arriving_files(spark, library, tmp_path_factory):
    out = []
    run = files.arriving(spark, library).writeStream.foreachBatch(lambda df, _: out.extend(r.content for r in df.collect())).option("checkpointLocation", str(tmp_path_factory.mktemp("state"))).trigger(availableNow=True).start()
    run.awaitTermination()
    assert out == ["one\n\ntwo"]


def test_stored_tables_are_shared_and_can_go(spark):
    df = stored(spark.range(5), "some")
    assert df.count() == 5 and df.stored_path.startswith(shared_dir(spark))
    discard(df)
    with pytest.raises(PySparkException):
        spark.read.parquet(df.stored_path).count()


def test_other_queries_run_without_the_training_data_subpackage(tmp_path):
    """The tree without lectern/llm and tests/llm, with and without corpus_pipeline.py, lists the other queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/lectern", tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'type_affinity' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path)
        if name == "__spark_entry__.py" or os.path.exists(f"{root}/{name}"):
            env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
            subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
