"""The segmented index, its pointer, its vocabulary's grams and variants, automata, and ranks by bounds of windows."""

import math
import os
import random
import re
import string
from itertools import product

import pytest
from pyspark.sql import functions as F
from tessera.functions.lexer import CJ_CLASS, Lexer
from tessera.operators.index import Conflict, IndexEngine, Pointer, ScanEngine
from tessera.operators.segments import FAN, Segment, document_terms, parse_segments, positions, to_merge, variants
from tessera.plans import automata, indexed, ranked
from tessera.plans.ast import Bool, Boost, Fuzzy, MatchAll, Phrase, Prefix, Regex, Term, Wildcard
from tessera.plans.indexed import VARIANT_PREFIX
from tessera.plans.parser import Parser
from tessera.plans.terms import osa
from tessera.plans.vocabulary import deletions, required_grams

STRINGS = ["".join(p) for n in range(5) for p in product("abc", repeat=n)]


@pytest.mark.parametrize("pattern", ["a(b|c)*", "[ab]+c?", "a{2,3}b*", "(ab|a)(c|bc)", "[^a]*", "a.c|b", "(a|b)*abb", "a{0}b", "(a*b*)*c", "()a", "a{2,}", '"a.c"|b'])
def test_automata_match_what_re_matches(pattern):
    plain = re.compile(re.sub(r'"(.*?)"', lambda m: re.escape(m[1]), pattern), re.S)
    machine = automata.automaton(pattern)
    assert [s for s in STRINGS if machine.matches(s)] == [s for s in STRINGS if plain.fullmatch(s)]


def test_complement_intersection_and_numbers():
    held = lambda p: {s for s in STRINGS if automata.automaton(p).matches(s)}
    for a, b in (("a*", "(ab)*"), ("[ab]+", "@c@"), ("~(a*)", "b@"), ("#", "@")):
        assert held(f"({a})&({b})") == held(a) & held(b) and held(f"~({a})") == set(STRINGS) - held(a)
        assert held(f"({a})|({b})") == held(a) | held(b) and held(f"~(({a})&~({b}))") == (set(STRINGS) - held(a)) | held(b)
    assert held("~a") == set(STRINGS) - {"a"} and held("~ab") == {s + "b" for s in STRINGS if len(s) < 4} - {"ab"}
    for low, high in (("0", "7"), ("3", "120"), ("95", "1004"), ("120", "3"), ("1000", "1000")):
        machine = automata.automaton(f"<{low}-{high}>")
        fixed = len(low) == len(high)
        for n in range(1300):
            inside = min(int(low), int(high)) <= n <= max(int(low), int(high))
            assert machine.matches(str(n)) == (inside and (not fixed or len(str(n)) == len(low))), (low, high, n)
        assert machine.matches("000" + str(int(low))) != fixed
    assert automata.automaton("<007-110>").matches("042") and not automata.automaton("<007-110>").matches("42")


@pytest.mark.parametrize("pattern", ["(a", "a)", "[a", "<1-", "<a-b>", "~", "a&", "|a", "*a", "a{x}&b", "a{3,2}", "a{9999}&b", "[z-a]&b", "a\\", '"a', "~(.*a.{14})"])
def test_bad_expressions_are_refused(pattern):
    with pytest.raises(automata.BadRegex):
        automata.automaton(pattern)


def test_automata_as_conditions(spark):
    words = ["", "a", "ab", "abc", "über", "x😀y", "漢字", "that", "the", "42", "042"]
    df = spark.createDataFrame([(w,) for w in words], "term string")
    for pattern in ("~(.*b.*)", "th@&~(.*e.*)", "<1-99>", ".{3}&~(the)", "#", "[^a-z]+&@", "ü@|x.y&@"):
        machine = automata.automaton(pattern)
        assert {r.term for r in df.where(machine.holds(F.col("term"))).collect()} == {w for w in words if machine.matches(w)}, pattern


def test_required_grams_lose_no_term():
    rng = random.Random(4)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(1500)}
    marked = {}
    for w in words:
        m = f"{automata.BEGIN}{w}{automata.END}"
        marked[w] = {m[i : i + 3] for i in range(len(m) - 2)}
    nodes = [Parser()(t).node for t in ("*abc", "?bcd*", "a?c*d", "*ab*cd*", "ab??", "*a*")]
    nodes += [Regex(p) for p in (".bcd|a[bc]da", "abc+d", "(abc)*d", "abcd?", "~(abc)", "@abc@&~(.*dd.*)", "a(bcd|dcb)a.*", "abc&.*c", "", "(abc|~d)")]
    tried = 0
    for node in nodes:
        pattern = automata.automaton(node.pattern) if isinstance(node, Regex) else None
        plain = None if pattern else re.compile("".join({"?": ".", "*": ".*"}[p] if special else re.escape(p) for p, special in node.parts)) if isinstance(node, Wildcard) else None
        needed = required_grams(node, 3)
        tried += needed is not None
        for w in words:
            holds = pattern.matches(w) if pattern else bool(plain.fullmatch(w))
            assert not holds or needed is None or any(g <= marked[w] for g in needed), (node, w)
    assert tried >= 8
    assert required_grams(Regex(".irst|p[ao]ir"), 3) == [{"irs", "rst", "st" + automata.END}, {"ir" + automata.END}]


def test_deletions_find_every_near_word(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 11))) for _ in range(250)})
    left = {w: deletions(w, 2, VARIANT_PREFIX) for w in words}
    for a in words:
        for b in words:
            if (d := osa(a, b)) <= 2:
                assert deletions(a, d, VARIANT_PREFIX) & left[b], (a, b)
    rows = variants(spark.createDataFrame([(w,) for w in [*words, "é😀"]], "term string")).collect()
    found = {}
    for r in rows:
        found.setdefault(r.term, []).append(r.variant)
    every = sorted({v for w in [*words, "é😀"] for v in deletions(w, 2, VARIANT_PREFIX)})
    hashed = dict(spark.createDataFrame([(v,) for v in every], "v string").select("v", F.xxhash64("v")).collect())
    assert all(sorted(found[w]) == sorted(hashed[v] for v in deletions(w, 2, VARIANT_PREFIX)) for w in [*words, "é😀"])


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def words_of(rng, n):
    return " ".join(rng.choice(string.ascii_lowercase[:8]) + rng.choice(string.ascii_lowercase) for _ in range(n))


def state(engine):
    return sorted((r.content_id, r.term, tuple(r.positions), r.length) for r in engine.tables().postings.collect())


def test_segments_hold_what_one_index_would(spark, tmp_path):
    rng = random.Random(1)
    many, truth = IndexEngine(spark, str(tmp_path / "many")), {}
    make = lambda rows: spark.createDataFrame(rows, "content_id long, content string")
    snapshots = []
    for step in range(7):
        rows = [(rng.randrange(12), rng.choice([None, "", words_of(rng, 6)])) for _ in range(1 if step else 12)]
        rows = list(dict(rows).items())
        if step == 3:
            gone = [rows[0][0], 99]
            many.remove(spark.createDataFrame([(i,) for i in gone], "content_id long"))
            [truth.pop(i, None) for i in gone]
        else:
            many.update(make(rows))
            truth |= dict(rows)
        snapshots.append((many.segments.pointer.get(), dict(truth)))
    one = IndexEngine(spark, str(tmp_path / "one"))
    one.update(make(list(truth.items())))
    assert state(many) == state(one)
    assert {r.content_id for r in many.tables().documents.collect()} == set(truth)
    assert len(parse_segments(many.segments.pointer.get())) < 7
    # A reader of an older list still sees its own state, also across the merge.
    version, then = snapshots[2]
    assert {r.content_id for r in many.tables(version).documents.collect()} == set(then)
    many.vacuum(1)
    assert state(many) == state(one)


def test_an_update_writes_in_proportion_to_itself(spark, tmp_path):
    rng = random.Random(2)
    engine = IndexEngine(spark, str(tmp_path / "ix"))
    engine.update(spark.createDataFrame([(i, words_of(rng, 300)) for i in range(3000)], "content_id long, content string"))
    before = folder_bytes(tmp_path)
    engine.update(spark.createDataFrame([(7, "one new text")], "content_id long, content string"))
    assert folder_bytes(tmp_path) - before < before / 20
    assert {r.content_id for r in engine.search("new").rows.collect()} == {7}


def test_merges_take_neighbours_of_like_size():
    sized = lambda *ns: [Segment(str(i), n, n) for i, n in enumerate(ns)]
    assert FAN == 4 and to_merge(sized(1000, 1, 1, 1)) is None and to_merge(sized(1000, 1, 1, 1, 1)) == slice(1, 5)
    assert to_merge(sized(1000, 4, 5, 6, 1, 1, 1)) == slice(1, 7) and to_merge(sized(1000, 4, 5, 1, 1)) == slice(1, 5) and to_merge([]) is None
    assert parse_segments(",".join(map(str, sized(3, 4)))) == sized(3, 4)


def test_pointers_are_never_seen_half_written(spark, tmp_path):
    one, two = Pointer(spark, str(tmp_path / "p")), Pointer(spark, str(tmp_path / "p"))
    assert one.current() == (-1, None)
    one.set("a", -1)
    with pytest.raises(Conflict):
        two.set("b", -1)
    assert two.current() == (0, "a") and not [n for n in os.listdir(tmp_path / "p") if n.startswith(".draft")]
    # What a writer left that died before it renamed its draft doesn't count.
    (tmp_path / "p" / ".draft-x").write_text("")
    two.set("b", 0)
    assert one.current() == (1, "b") and all((tmp_path / "p" / n).read_text() for n in os.listdir(tmp_path / "p") if n.startswith("CURRENT"))


def test_patterns_go_through_the_vocabulary(spark, tmp_path):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["station", "nation", "first", "pair", "poir", "thirst", "that", "the", "42", "7"]) + rng.choice(["", "s"]) for _ in range(3))) for i in range(60)], "content_id long, content string")
    engine = IndexEngine(spark, str(tmp_path / "ix"))
    engine.update(docs)
    scan = ScanEngine(docs)
    for text in ("*tion", "*atio*", "/.irst|p[ao]ir/", "?h?rst", "/th@&~(.*e.*)/", "/<5-50>/", "nathion~2", "fisrt~1", "pair~1 -the", "*zzz*", "s*", "[n TO p]"):
        assert {r.content_id for r in engine.search(text, None).rows.collect()} == {r.content_id for r in scan.search(text, None).rows.collect()}, text
    for text in ("*tion", "/.irst|p[ao]ir/", "/th@&~(.*e.*)/"):
        found = engine.search(text, None).rows
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "RLIKE" not in plan and "aggregate(" not in plan and ("In(term" in plan or "EqualTo(term" in plan), plan
        assert all("/postings-" in f for f in found.inputFiles())
    assert all("/variants-" in f for f in engine.tables().terms(Fuzzy("nathion", 2)).inputFiles())


# Ranks.


def plain_score(node, words, idf):
    """None where the tree doesn't hold."""
    if isinstance(node, Boost):
        s = plain_score(node.node, words, idf)
        return None if s is None else s * node.factor
    if isinstance(node, Bool):
        of = {occur: [plain_score(n, words, idf) for o, n in node.clauses if o == occur] for occur in ("+", "", "-")}
        if any(s is not None for s in of["-"]) or any(s is None for s in of["+"]) or not of["+"] and all(s is None for s in of[""]):
            return None
        return sum(s for s in of["+"] + of[""] if s is not None)
    if isinstance(node, MatchAll):
        return 1.0
    if isinstance(node, Term):
        tf, weight = words.count(node.word), idf(node.word)
    elif isinstance(node, Phrase):
        tf = sum(tuple(words[i : i + len(node.words)]) == node.words for i in range(len(words)))
        weight = sum(idf(w) for w in node.words)
    else:
        holds = {Prefix: lambda w: w.startswith(node.prefix), Regex: lambda w: re.fullmatch(node.pattern, w)}[type(node)]
        return 1.0 if any(holds(w) for w in words) else None
    return math.sqrt(tf) / math.sqrt(len(words)) * weight**2 if tf else None


TREES = ("aa^3 bb", "+aa^0.5 \"aa bb\"^2 -cc", "(aa OR bb^4) AND (c* OR dd^2)^0.5", "*:* aa^2", "rare", "NOT aa", "nothing", "aa AND nothing", "\"bb aa\"", "/a[ab]/ -dd", "+(aa bb) +(cc dd)")


def test_ranks_are_those_of_every_score(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranked, "FIRST_WINDOWS", 2)
    rng = random.Random(6)
    texts = {i * 3 - 40: " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(rng.randint(1, 30))) for i in range(150)}
    texts[50] = "rare " * 5
    texts[200], texts[203] = None, ""
    engine = IndexEngine(spark, str(tmp_path / "ix"), window=16)
    engine.update(spark.createDataFrame(list(texts.items()), "content_id long, content string"))
    lexed = {i: (t or "").split() for i, t in texts.items()}

    def idf(word):
        return 1 + math.log(len(texts) / (sum(word in ws for ws in lexed.values()) + 1))

    for text in TREES:
        node = Parser()(text).node
        scores = [(i, round(s, 9)) for i, ws in lexed.items() if (s := plain_score(node, ws, idf)) is not None]
        want = sorted(scores, key=lambda x: (-x[1], x[0]))
        for k in (1, 10, 1000) if text in TREES[:2] else (10,):
            got = [(r.content_id, round(r.score, 8)) for r in engine.search(text, k, ranked=True).rows.collect()]
            assert got == [(i, round(s, 8)) for i, s in want[:k]], (text, k)
    assert [r.content_id for r in engine.search(text, None, ranked=True).rows.collect()] == [i for i, _ in want]


def test_bounds_leave_windows_unread(spark, tmp_path, monkeypatch):
    """Of 100 windows, few can hold one of the ten best; with two segments, too."""
    monkeypatch.setattr(ranked, "FIRST_WINDOWS", 4)
    rows = [(i, "good " * (9 if i // 10 in (3, 41) else 1) + "filler " * (1 if i // 10 in (3, 41) else 20 + i % 7)) for i in range(1000)]
    engine = IndexEngine(spark, str(tmp_path / "ix"), window=10)
    engine.update(spark.createDataFrame(rows, "content_id long, content string"))
    best = ranked.Ranking(engine.tables(), Parser()("good^2 filler").node).best(10)
    assert best.there == 200 and best.read <= 12
    assert [r.content_id for r in best.rows.collect()] == list(range(30, 40))
    engine.update(spark.createDataFrame([(35, "filler"), (2000, "good good good")], "content_id long, content string"))
    best = ranked.Ranking(engine.tables(), Parser()("good").node).best(5)
    assert [r.content_id for r in best.rows.collect()] == [2000, 30, 31, 32, 33] and best.read < 20
    plan = best.rows._jdf.queryExecution().executedPlan().toString()
    assert "window" in plan and "PushedFilters" in plan


def test_texts_are_exchanged_and_postings_are_not(spark, tmp_path, monkeypatch):
    """Every (term, window) has its rows in one file, so that grouping by document or window is done where they are read."""
    rng = random.Random(11)
    docs = spark.createDataFrame([(i, words_of(rng, 60)) for i in range(400)], "content_id long, content string").repartition(5)
    assert "hashpartitioning" not in document_terms(docs, Lexer())._jdf.queryExecution().executedPlan().toString()
    engine = IndexEngine(spark, str(tmp_path / "ix"), window=16)
    engine.update(docs)
    files = engine.tables().postings.select("term", "window", F.input_file_name().alias("f")).distinct()
    assert files.groupBy("term", "window").count().where("count > 1").isEmpty()
    monkeypatch.setattr(indexed, "NAMED_TERMS", 0)
    found = engine.search("a*", None).rows
    assert "LeftSemi" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == ScanEngine(docs).search("a*", None).rows.count()


def test_positions_of_repeated_and_null_ids(spark):
    rows = [(1, "b a b"), (1, "a c"), (None, "x y"), (None, "x"), (2, None), (3, "ΣΑΣ Ab"), (4, "")]
    got = {(r.content_id, r.term): r.positions for r in positions(spark.createDataFrame(rows, "content_id long, content string")).collect()}
    assert got == {(1, "b"): [0, 2], (1, "a"): [0, 1], (1, "c"): [1], (None, "x"): [0, 0], (None, "y"): [1], (3, "σασ"): [0], (3, "ab"): [1]}


def test_cheaper_pattern_finds_the_same_words(spark):
    """Against the plain intersections of classes, for every character of the BMP and some beyond, and with extra ones."""
    codes = [c for c in range(0x1, 0x10000) if not 0xD800 <= c < 0xE000] + [0x10400, 0x1D7D8, 0x20000, 0x1F600]
    texts = ["".join(map(chr, codes[i : i + 300])) for i in range(0, len(codes), 300)] + ["".join(f"a{chr(c)}b" for c in codes[i : i + 300]) for i in range(0, len(codes), 300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for lexer in (Lexer(preserve_case=True), Lexer("@#$%'é漢^]-", True, 3)):
        word = r"\p{L}\p{Nd}_" + "".join(f"\\x{{{ord(c):X}}}" for c in lexer.extra)
        plain = f"[{word}&&[{CJ_CLASS}]]|[{word}&&[\\x{{0}}-\\x{{FFFF}}]&&[^{CJ_CLASS}]]{{1,{lexer.max_length}}}"
        assert df.where(lexer.terms(F.col("t")) != F.regexp_extract_all("t", F.lit(plain), F.lit(0))).isEmpty()


def test_limits_are_the_smallest_ids(spark, tmp_path):
    engine = IndexEngine(spark, str(tmp_path / "ix"))
    engine.update(spark.createDataFrame([(i, "word") for i in (5, 3, 9, 1)], "content_id long, content string"))
    found = engine.search("word", 2)
    assert sorted(r.content_id for r in found.rows.collect()) == [1, 3] and found.truncated() and not engine.search("word", 20).truncated()
