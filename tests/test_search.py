import random
import re
import pytest
from pyspark.sql import functions as F
from tessera.functions import tolerant
from tessera import queries
from tessera.functions.lexer import Lexer
from tessera.operators.index import IndexEngine, ScanEngine
from tessera.plans.ast import AND, NEGATIVE_WARNING, NOT, OR, POSTFIX_WARNING, Builder
from tessera.plans.parser import Parser
from tessera.plans.terms import UnsupportedRegex, java_regex, osa

LEXED = [
    ("Spears were 1.5 metres long.", "", False, "spears were 1 5 metres long"),
    ("Пасхалия на 312—412 годы;", "", False, "пасхалия на 312 412 годы"),
    ("末尾の年表も参照。", "", False, "末 尾 の 年 表 も 参 照"),
    ("術：變化術", "", False, "術 變 化 術"),
    ("Speed: 210 MPH", "", True, "Speed 210 MPH"),
    ("Speed: 210 MPH", "", False, "speed 210 mph"),
    ("some@email.ru", "", False, "some email ru"),
    ("some@email.ru", "@.", False, "some@email.ru"),
    ("abc火垂るdef 한국어", "", False, "abc 火 垂 る def 한국어"),
    ("・㌀ﾊﾛ", "", False, "ﾊ ﾛ"),
    ("𠀀 😀 ab", "", False, "ab"),
    ("a_b ΟΔΟΣ", "", False, "a_b οδοσ"),
    ("", "", False, ""),
]


@pytest.mark.parametrize("extra,preserve", sorted({(e, p) for _, e, p, _ in LEXED}))
def test_lexer(spark, extra, preserve):
    cases = [(t, w.split()) for t, e, p, w in LEXED if (e, p) == (extra, preserve)]
    lexer = Lexer(extra, preserve)
    rows = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(lexer.terms(F.col("t")).alias("k")).collect()
    assert [r.k for r in rows] == [w for _, w in cases]
    assert [lexer.tokens(t) for t, _ in cases] == [w for _, w in cases]


def test_long_words_are_cut(spark):
    row = spark.createDataFrame([("x" * 300, None)], "a string, b string").select(Lexer().terms(F.col("a")).alias("a"), Lexer().terms(F.col("b")).alias("b")).first()
    assert [len(w) for w in row.a] == [256, 44] and row.b == []
    assert [len(w) for w in Lexer().tokens("x" * 300)] == [256, 44]
    with pytest.raises(ValueError):
        Lexer("@", custom=lambda c: F.split(c, " "))
    assert Lexer().offsets("The fox, the") == [("the", 0), ("fox", 4), ("the", 9)]


B = Builder(Parser())
v = B.value
DOCS4 = {1: "1 2    ", 2: "1 2 3  ", 3: "1 2 3 4", 4: "1     4"}
WORDS = {11: "12  ", 12: "123 ", 13: "1234", 14: "14  "}
TEXTS = {21: "first one unit", 22: "second two pair", 23: "phrase number one", 24: "second sentence"}
CASES = [
    (v("1"), {1, 2, 3, 4}), (v("2"), {1, 2, 3}), (v("3"), {2, 3}), (v("4"), {3, 4}),
    (B.phrase("1", "2"), {1, 2, 3}), (B.phrase("2", "3"), {2, 3}), (B.phrase("1", "4"), {4}), (B.phrase("1", "3"), set()),
    (B.boolean([(AND, v("3")), (AND, v("4"))]), {3}), (B.boolean([(OR, v("3")), (OR, v("4"))]), {2, 3, 4}),
    (B.boolean([(AND, v("2")), (NOT, v("4"))]), {1, 2}), (B.boolean([(AND, v("3")), (OR, v("4"))]), {3}),
    (B.boolean([(AND, v("2")), (OR, v("3")), (OR, v("4"))]), {2, 3}),
    (B.prefix("12"), {11, 12, 13}), (B.prefix("14"), {14}), (B.prefix("23"), set()),
    ("number", {23}), ("sentence", {24}), ("sentence OR phrase", {23, 24}), ("sentence phrase", {23, 24}),
    ("/f?irst/", {21}), ("/pa.+/", {22}), ("/.irst|p[ao]ir/", {21, 22}), ("*irst", {21}), ("?air", {22}),
    ('"one unit"', {21}), ('"unit one"', set()), ('"first unit"~1', {21}), ("frist~1", {21}), ("frist~0", set()), ("unot~", {21}),
    ("[uni TO unit]", {21}), ("{pair TO phrase}", set()), ("[pair TO phrase}", {22}), ("second NOT pair", {24}), ("+second -pair", {24}),
    ("second AND pair OR sentence", {22}), ("(first OR second) AND two", {22}), ("content:(pair OR unit)", {21, 22}), ("title:pair", set()),
    ("SECOND && !two", {24}), ("first\\:one", {21}), ("pair^2 unit^0.5", {21, 22}), ("2 AND (NOT 4)", {1, 2}), ("...", set()),
]


def all_docs(spark):
    return spark.createDataFrame(list((DOCS4 | WORDS | TEXTS).items()), "content_id long, content string")


def test_scan_and_index_agree(spark, tmp_path):
    docs = all_docs(spark)
    scan, index = ScanEngine(docs), IndexEngine(spark, str(tmp_path / "index"))
    index.update(docs)
    for query, expected in CASES:
        assert {r.content_id for r in scan.search(query).rows.collect()} == expected, query
        assert {r.content_id for r in index.search(query).rows.collect()} == expected, query
    everything = {r.content_id for r in docs.collect()}
    for query, gone in (("NOT 2", {1, 2, 3}), (B.boolean([(NOT, v("2"))]), {1, 2, 3}), ("*:*", set())):
        assert {r.content_id for r in index.search(query).rows.collect()} == everything - gone
        assert {r.content_id for r in scan.search(query).rows.collect()} == everything - gone


def test_errors_and_warnings():
    parse = Parser()
    for text in ("phrase (", "", "  ", "a AND", "a~1.5", "[a b]", ")", "^2", "a^", 'x "y'):
        query = parse(text)
        assert query.errors and query.node is None, text
    for text in ("NOT 1", "a AND (NOT b)"):
        assert parse(text).warnings[0].startswith(NEGATIVE_WARNING)
    for text in ("*warn", "?warn", "?*warn", "some AND ?warn", 'content: ("some phrase" OR *warn)'):
        assert [w.split(":")[0] for w in parse(text).warnings] == [POSTFIX_WARNING], text
    assert not parse("a AND b NOT c").warnings and not parse("/.*x/").warnings
    assert B.boolean([(NOT, v("1"))]).warnings
    assert B.boolean([(AND, parse("(")), (AND, v("1"))]).errors
    with pytest.raises(UnsupportedRegex):
        java_regex("a~b")


def test_phrase_of_single_characters():
    assert str(Parser()("火垂る").node) == 'content:"火 垂 る"'
    assert "-" not in str(Parser(auto_phrase=False)("火垂る").node) and len(Parser(auto_phrase=False)("火垂る").node.clauses) == 3
    assert [osa("ca", "abc"), osa("ab", "ba"), osa("", "ab"), osa("kitten", "sitting")] == [3, 1, 2, 3]


def test_update_and_remove(spark, tmp_path):
    index = IndexEngine(spark, str(tmp_path / "index"))
    ids = lambda q: {r.content_id for r in index.search(q).rows.collect()}
    put = lambda *rows: index.update(spark.createDataFrame(list(rows), "content_id long, content string"))
    assert ids("phrase") == set()
    put((11, "phrase to be searched"))
    assert ids("phrase") == {11}
    put((1, "original phrase"), (2, None))
    put((1, "changed phrase"))
    assert ids("original") == set() and ids("changed") == {1} and ids("phrase") == {1, 11} and ids("NOT phrase") == {2}
    index.remove(spark.createDataFrame([(11,)], "content_id long"))
    assert ids("phrase") == {1}
    index.vacuum(1)
    assert ids("phrase") == {1}
    assert index.search("a (").failed


def test_tolerant_queries_take_whole_texts(spark, tmp_path):
    rows = [(1, "a AND\nfield: (b\r\nc)\n\nd"), (2, None), (3, "\nlast"), (4, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokens = queries.tolerant_tokens(spark, str(tmp_path)).collect()
    got = {d: [(t.pos, t.value, t.parent_field) for t in tokens if t.doc_id == d] for d, _ in rows}
    assert got[1] == [(0, "a", None), (2, "AND", None), (6, "field", "field"), (11, ":", "field"), (13, "(", "field"), (14, "b", "field"), (17, "c", "field"), (18, ")", "field"), (21, "d", None)]
    assert got[2] == [] and got[3] == [(1, "last", None)] and got[4] == [(0, "one", None)]
    under = {r.doc_id: (r.pos, r.value) for r in queries.edited_tokens(spark, str(tmp_path)).collect()}
    assert under[1] == (6, "field") and under[2] == (0, "") and under[3] == (1, "last") and under[4] == (0, "one")


def test_fuzzy_finds_every_near_term(spark, tmp_path):
    rows = [(i, f"idiot{c}") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")] + [(100 + i, f"{c}idiot") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
    docs = spark.createDataFrame([*rows, (200, "idiot"), (201, "idea")], "content_id long, content string")
    index = IndexEngine(spark, str(tmp_path / "index"))
    index.update(docs)
    for engine in (ScanEngine(docs), index):
        assert {r.content_id for r in engine.search("idiot~1", None).rows.collect()} == {200, *(i for i, _ in rows)}


def test_bad_patterns_are_errors_of_the_result(spark):
    for text in ("/(a/", "/[z-a]/", "/a~/", "/a&/", "/<1-/", "/*/", "/<a-b>/"):
        assert Parser()(text).errors, text
    for text in ('/a(b|c)"."[0-9]+/', "/a~b/", "/a&b/", "/<1-5>/"):
        assert not Parser()(text).errors, text


def test_runs_of_plain_characters_are_one_unit(monkeypatch):
    """And the tokens are those of a scan character by character."""
    rng = random.Random(8)
    signs = [*"&|+-!(){}[]^\"~*?:\\/ \n漢aé", "AND", "OR", "NOT", "TO", "TO ", "TOM", "abc", "field:", "\\/"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    assert len(tolerant._Scan("word and word").units) == 5
    runs = [(tolerant.tokenize(t), tolerant.edited_token(t, len(t) // 2)) for t in texts]
    monkeypatch.setattr(tolerant, "_UNIT", re.compile(r"(?P<space>\s+)|\\[" + re.escape(tolerant.SPECIAL) + r"]|.", re.S))
    assert runs == [(tolerant.tokenize(t), tolerant.edited_token(t, len(t) // 2)) for t in texts]
