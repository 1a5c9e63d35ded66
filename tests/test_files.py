import os
import time

from pyspark.sql import functions as F
from tessera.functions import text as fn
from tessera.functions.tolerant import QueryTokens, edited_token, tokenize
from tessera.operators import mirror
from tessera.operators.index import IndexEngine
from tessera.sources.files import Config, listing, read_texts
from tessera.streaming.tree import CHANGED, CREATED, DELETED, DIRECTORY, FILE, FOUND, RENAMED, UNCERTAIN, Tree, replay
from tessera.streaming.watch import FileChanges, FileIndex


def write(path, text, data=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if data is not None else text.encode())


def test_read_texts(spark, tmp_path):
    top = str(tmp_path / "in")
    write(f"{top}/a.txt", "﻿hello")
    write(f"{top}/sub/b.TXT", "", "привет".encode("cp1251"))
    write(f"{top}/c.log", "x")
    write(f"{top}/index/d.txt", "x")
    write(f"{top}/long.txt", "y" * 100)
    charset = F.when(F.col("path").endswith("b.TXT"), "cp1251").when(F.col("path").endswith("a.txt"), "utf-8").otherwise("none")
    texts, long, failed = read_texts(spark, [top], r"\.txt$", charset, 100, exclude=f"{top}/index")
    assert {os.path.basename(r.path): r.content for r in texts.collect()} == {"a.txt": "hello", "b.TXT": "привет"}
    assert [os.path.basename(r.path) for r in long.collect()] == ["long.txt"] and failed.count() == 0
    _, _, failed = read_texts(spark, [f"{top}/c.log"], charset="none")
    assert failed.count() == 1
    assert listing(spark, [top]).count() == 5


def test_file_index_follows_files(spark, tmp_path):
    top = str(tmp_path / "in")
    write(f"{top}/one.txt", "first text")
    write(f"{top}/sub/two.txt", "second text")
    index = FileIndex(spark, str(tmp_path / "state"), [top])
    found = lambda q: [os.path.relpath(r.path, top) for r in index.search(q).rows.collect()]
    assert found("text") == []
    index.refresh()
    assert found("text") == ["one.txt", "sub/two.txt"]
    os.rename(f"{top}/sub", f"{top}/renamed")
    write(f"{top}/one.txt", "changed content")
    diff = {os.path.relpath(r.path, top): r.change_type for r in index.refresh().collect()}
    assert diff == {"renamed/two.txt": RENAMED, "one.txt": CHANGED}
    assert found("text") == ["renamed/two.txt"] and found("changed") == ["one.txt"]
    os.remove(f"{top}/one.txt")
    index = FileIndex(spark, str(tmp_path / "state"), [top])  # a later session
    index.refresh()
    assert found("changed") == [] and index.search("a (").failed


def test_change_stream(spark, tmp_path):
    top = str(tmp_path / "in")
    write(f"{top}/a.txt", "one")
    spark.dataSource.register(FileChanges)
    stream = spark.readStream.format("file_changes").options(paths=top, journal=str(tmp_path / "journal"), pattern=r"\.txt$").load()
    query = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()

    def wait(n):
        for _ in range(150):
            rows = spark.sql("select * from seen order by seq").collect()
            if len(rows) >= n:
                return [(r.change_type, os.path.basename(r.path)) for r in rows]
            time.sleep(0.2)
        raise AssertionError(rows)

    try:
        assert wait(1) == [(CREATED, "a.txt")]
        os.rename(f"{top}/a.txt", f"{top}/b.txt")
        assert wait(2)[1:] == [(RENAMED, "b.txt")]
        write(f"{top}/b.txt", "longer text")
        assert wait(3)[2:] == [(CHANGED, "b.txt")]
        os.remove(f"{top}/b.txt")
        assert wait(4)[3:] == [(DELETED, "b.txt")]
    finally:
        query.stop()


def test_tree_transitions():
    def run(*changes, accepts=lambda p, k: True):
        tree = Tree(accepts)
        for c in changes:
            tree.apply(*c)
        return {p: c for p, _, c in tree.entries.values()}

    assert run((CREATED, FILE, "/a"), (RENAMED, FILE, "/b", "/a")) == {"/b": 0}
    assert run((CREATED, FILE, "/a"), (CHANGED, FILE, "/A")) == {"/A": 1}
    assert run((CREATED, DIRECTORY, "/d"), (CREATED, FILE, "/d/f"), (RENAMED, UNCERTAIN, "/e", "/d")) == {"/e": None, "/e/f": 0}
    assert run((CREATED, DIRECTORY, "/d"), (CREATED, FILE, "/d/f"), (CREATED, DIRECTORY, "/d")) == {"/d": None, "/d/f": 0}
    assert run((CREATED, DIRECTORY, "/d"), (CREATED, FILE, "/d/f"), (DELETED, UNCERTAIN, "/d")) == {}
    assert run((CREATED, FILE, "/d"), (CREATED, DIRECTORY, "/d")) == {"/d": None}
    assert run((CREATED, FILE, "/a"), (FOUND, FILE, "/a")) == {"/a": 0}
    assert run((RENAMED, FILE, "/b", "/a")) == {"/b": 0}
    assert run((CREATED, FILE, "/a"), (CREATED, FILE, "/b"), (RENAMED, FILE, "/b", "/a")) == {"/b": 0}
    inside = lambda p, k: p.startswith("/in")
    assert run((CREATED, FILE, "/in/a"), (RENAMED, FILE, "/out/a", "/in/a"), accepts=inside) == {}
    assert run((CREATED, FILE, "/out/a"), (RENAMED, FILE, "/in/a", "/out/a"), accepts=inside) == {"/in/a": 0}


def test_replay_and_mirror_joins(spark):
    rows = [("t", 1, FILE, CREATED, "/t/a", None), ("t", 2, FILE, RENAMED, "/t/b", "/t/a"), ("u", 1, FILE, CREATED, "/u/x", None)]
    changes = spark.createDataFrame(rows, "target string, seq long, entry_type string, change_type string, path string, old_path string")
    assert {(r.target, r.path, r.content_id) for r in replay(changes).collect()} == {("t", "/t/b", 0), ("u", "/u/x", 0)}
    targets = spark.createDataFrame([(DIRECTORY, "/T"), (FILE, "/u/x"), (DIRECTORY, "/t/sub"), (DIRECTORY, "/gone")], "type string, path string")
    entries = spark.createDataFrame([("/t/b", FILE), ("/t/sub/c.tmp", FILE), ("/u/x", FILE), ("/u/y", FILE), ("/tt", FILE)], "path string, entry_type string")
    got = mirror.watched(entries, targets, ~F.col("path").endswith(".tmp"))
    assert {r.path for r in got.collect()} == {"/t/b", "/u/x"}
    there = spark.createDataFrame([("/t",), ("/u/x",), ("/t/sub",)], "path string")
    assert {r.path: r.state for r in mirror.target_states(targets, there).collect()} == {"/T": "Active", "/u/x": "Active", "/t/sub": "Suspended", "/gone": "Failed"}
    files = spark.createDataFrame([("/t/b", 1), ("/t/c", 1), ("/u/x", 2)], "path string, content_id long")
    gone = mirror.deleted_below(files, spark.createDataFrame([("/u",)], "path string"))
    assert [r.content_id for r in mirror.orphaned(files, gone).collect()] == [2]
    assert {r.path for r in mirror.moved_below(files, "/t", "/new").collect()} == {"/new/b", "/new/c", "/u/x"}
    tree = mirror.tree_lines(spark.createDataFrame([("/d", DIRECTORY), ("/d/b", FILE), ("/d/A", FILE), ("/d/e", DIRECTORY), ("/d/e/f", FILE), ("/d/q", UNCERTAIN)], "path string, entry_type string"))
    assert [r.line for r in tree.orderBy("key").collect()] == ["d/", "\tA", "\tb", "\tq?", "\te/", "\t\tf"]


def test_targets_and_config():
    for kind, path in ((FILE, "/"), ("Root", "/a"), (FILE, "a/b"), (DIRECTORY, "")):
        try:
            mirror.Target(kind, path)
        except ValueError:
            continue
        raise AssertionError((kind, path))
    c = Config.from_xml("<c><FileNameRegex>x</FileNameRegex><Directory>/a</Directory><Directory>/b</Directory><AdditionalWordChars>@#</AdditionalWordChars><CaseSensitive>true</CaseSensitive></c>")
    assert (c.file_name_regex, c.directories, c.max_file_length, c.lexer().extra, c.case_sensitive) == ("x", ["/a", "/b"], 64 << 20, "@#", True)


def test_text_functions(spark):
    assert [fn.clipboard_query(t) for t in ("search: a\nb", "a+b", "a b", "x\n y z", " \n")] == ["a b", r"a\+b", '"a b"', '"x y z"', ""]
    for values, least in (([0, 1, 2, 3, 4], 2), ([], 0), ([0, 1], 5)):
        assert fn.first_index_of(values, lambda x: x >= least) == next((i for i, x in enumerate(values) if x >= least), -1)
    assert [fn.last_index_of([0, 1, 2, 3, 4], lambda x, v=v: x <= v) for v in (0, 4, -1)] == [0, 4, -1]
    row = spark.createDataFrame([([0, 1, 2, 3, 4], 180_000, "a b  // note", 'a:(b)')], "a array<int>, ms long, e string, q string").select(
        fn.first_index(F.col("a"), lambda x: x >= 3).alias("f"), fn.last_index(F.col("a"), lambda x: x <= 3).alias("l"), fn.first_index(F.col("a"), lambda x: x > 9).alias("n"),
        fn.duration_text(F.col("ms")).alias("d"), fn.example_query(F.col("e")).alias("e"), fn.unescape_query(fn.escape_query(F.col("q"))).alias("q"),
        fn.task_state(F.lit(False), F.lit(False), F.lit(False)).alias("s"), fn.scan_status(F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(1)).alias("u"),
    ).first()
    assert tuple(row) == (3, 3, -1, "3m", "a b", "a:(b)", "completed", "not scanned")


def test_tolerant_tokens(spark):
    tokens, errors = tokenize("content:(a OR b)")
    assert [(t.type, t.position) for t in tokens] == [("Field", 0), ("Colon", 7), ("OpenGroup", 8), ("FieldValue", 9), ("Or", 11), ("FieldValue", 14), ("CloseGroup", 15)]
    assert {t.parent_field for t in tokens} == {"content"} and not errors
    assert tokenize("(a]) )")[1] == ["Unexpected ] at 2 closing ( at 0", "Unmatched ) at 5"]
    assert [t.type for t in tokenize("/a b/ ANDY [x TO y} z^2")[0]] == ["OpenRegex", "RegexBody", "CloseRegex", "FieldValue", "OpenClosedRange", "FieldValue", "To", "FieldValue", "CloseOpenRange", "FieldValue", "BoostModifier", "ModifierValue"]
    assert edited_token("content:abc", 10).value == "abc"
    assert edited_token("", 0).type == "Field" and edited_token("f:", 2).type == "FieldValue" and edited_token("a~", 2).type == "ModifierValue"
    for text in ("((((", "\\", '"', "/", "a:b:c", "&|&", "[TO TO", "*", "火~^"):
        tokenize(text), edited_token(text, len(text) // 2)
    spark.udtf.register("query_tokens", QueryTokens)
    assert spark.sql("select * from query_tokens('a AND b')").count() == 3


def test_another_file_of_equal_length_and_time_is_no_rename(spark, tmp_path):
    top = tmp_path / "watched"
    top.mkdir()
    (top / "a.txt").write_text("alpha")
    os.utime(top / "a.txt", (1_700_000_000, 1_700_000_000))
    index = FileIndex(spark, str(tmp_path / "ix"), [str(top)])
    index.refresh()
    (top / "a.txt").unlink()
    (top / "b.txt").write_text("gamma")
    os.utime(top / "b.txt", (1_700_000_000, 1_700_000_000))
    index.refresh()
    found = lambda q: [os.path.basename(r.path) for r in index.search(q).rows.collect()]
    assert found("gamma") == ["b.txt"] and found("alpha") == []
    os.rename(top / "b.txt", top / "c.txt")
    assert [r.change_type for r in index.refresh().collect()] == [RENAMED] and found("gamma") == ["c.txt"]


def test_files_that_cant_be_read_keep_their_text(spark, tmp_path):
    top = tmp_path / "watched"
    top.mkdir()
    (top / "a.txt").write_text("alpha")
    index = FileIndex(spark, str(tmp_path / "ix"), [str(top)])
    index.refresh()
    index.charset = "no-such-charset"
    (top / "a.txt").write_text("changed text")
    (top / "b.txt").write_text("new")
    assert index.refresh().count() == 0 and {os.path.basename(r.path) for r in index.failures().collect()} == {"a.txt", "b.txt"}
    assert [os.path.basename(r.path) for r in index.search("alpha").rows.collect()] == ["a.txt"]
    index.charset = "UTF-8"
    assert {r.change_type for r in index.refresh().collect()} == {CHANGED, "Created"} and index.failures().count() == 0
    assert index.search("alpha").rows.count() == 0 and index.search("changed").rows.count() == 1


def test_no_update_is_lost_between_two_writers(spark, tmp_path):
    docs = lambda i, t: spark.createDataFrame([(i, t)], "content_id long, content string")
    one, two = IndexEngine(spark, str(tmp_path / "ix")), IndexEngine(spark, str(tmp_path / "ix"))
    one.update(docs(1, "first"))
    plain, times = one.segments.pointer.current, []

    def late():
        found = plain()
        if not times:
            times.append(1)
            two.update(docs(2, "second"))
        return found

    one.segments.pointer.current = late
    one.update(docs(3, "third"))
    assert sorted(r[0] for w in ("first", "second", "third") for r in two.search(w).rows.collect()) == [1, 2, 3]


def test_size_places(spark):
    rows = [(i, (i * 7) % 5 if i % 6 else None) for i in range(50)] + [(8, 1), (8, 1)]
    empty = spark.createDataFrame([], "seq long, length int")
    assert mirror.size_places(empty).collect() == []
    placed = mirror.size_places(spark.createDataFrame(rows, "seq long, length int").repartition(7)).collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [(r.seq, r.length) for r in sorted(placed, key=lambda r: r.place)] == want
    assert sorted(r.place for r in placed) == list(range(1, len(rows) + 1))
