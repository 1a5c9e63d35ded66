"""The engine's operators as queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.functions.lexer import Lexer, has_cjk
from tessera.functions.tolerant import edited_token, highlight, tokenize
from tessera.operators import mirror
from tessera.operators.index import IndexEngine, ScanEngine, files_of, positions, relevance, top_hits
from tessera.operators.segments import has_repeats
from tessera.operators.snippets import offsets, snippets
from tessera.operators.work import ADD, REMOVE, pending, work_order
from tessera.plans.ast import AND, NOT, OR, Builder
from tessera.plans.parser import Parser
from tessera.sources.shared import shared_dir
from tessera.streaming.tree import debounced

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").toDF("content_id", "content")


_WORD = r"[\x{3040}-\x{312F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]|[\p{L}\p{Nd}_]+"  # no word of the tables has over 256 characters


def _lexed(pattern: str = _WORD, lower: bool = True) -> str:
    found = f"regexp_extract_all(coalesce(text, ''), '{pattern}', 0)"
    return f"k AS (SELECT doc_id AS content_id, {f'list_transform({found}, lambda x: lower(x))' if lower else found} AS t FROM documents)"


def _token_counts(lexer: Lexer):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = docs(spark, sf_dir).select("content_id", F.explode(F.array(lexer.terms(F.col("content")))).alias("t"))
        if has_repeats(docs(spark, sf_dir)):
            terms = rows.select("content_id", F.explode("t").alias("term"))
            return terms.groupBy("term").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("content_id").alias("documents"))
        # Each row's terms and, after them, its distinct ones: all that is exchanged is counts. A row without an id is no document.
        both = rows.select("content_id", F.size("t").alias("n"), F.posexplode(F.concat("t", F.array_distinct("t"))).alias("pos", "term"))
        document = (F.col("pos") >= F.col("n")) & F.col("content_id").isNotNull()
        return both.groupBy("term").agg(F.count_if(F.col("pos") < F.col("n")).alias("occurrences"), F.count_if(document).alias("documents"))

    return run


for _name, _lexer, _pattern, _lower in (
    ("lex_token_counts", Lexer(), _WORD, True),
    ("lex_case_preserving", Lexer(preserve_case=True), _WORD, False),
    ("lex_extra_word_chars", Lexer(extra="@#$%'"), _WORD.replace("_]", "_@#$%'']"), True),
    ("lex_max_len", Lexer(max_length=5), _WORD.replace("]+", "]{1,5}"), True),
):
    QUERIES[_name] = _token_counts(_lexer)
    SQL[_name] = f"WITH {_lexed(_pattern, _lower)} SELECT term, count(*) AS occurrences, count(DISTINCT content_id) AS documents FROM (SELECT content_id, unnest(t) AS term FROM k) GROUP BY term"


@query(f"WITH {_lexed()}, p AS (SELECT content_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM k) SELECT content_id, term, count(*) AS n, min(pos)::BIGINT AS first, max(pos)::BIGINT AS last FROM p GROUP BY content_id, term")
def postings(spark, sf_dir):
    p = F.col("positions")
    return positions(docs(spark, sf_dir)).select("content_id", "term", F.size(p).cast("long").alias("n"), F.element_at(p, 1).cast("long").alias("first"), F.element_at(p, -1).cast("long").alias("last"))


@query(f"WITH {_lexed()} SELECT term, count(DISTINCT content_id) AS documents FROM (SELECT content_id, unnest(t) AS term FROM k) GROUP BY term")
def vocab_df(spark, sf_dir):
    return positions(docs(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


_INDEXES: dict[tuple[str, str], IndexEngine] = {}


def new_engine(spark: SparkSession) -> IndexEngine:
    return IndexEngine(spark, f"{shared_dir(spark)}/tessera-index-{uuid.uuid4().hex[:12]}")


def index(spark: SparkSession, sf_dir: str) -> IndexEngine:
    """The index of the documents under sf_dir, which a session writes once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        engine = new_engine(spark)
        engine.update(docs(spark, sf_dir))
        _INDEXES[key] = engine
    return _INDEXES[key]


@query(SQL["vocab_df"])
def index_vocabulary(spark, sf_dir):
    """The written vocabulary; the first query of a session on an index writes it."""
    return index(spark, sf_dir).tables().vocabulary


# Fixed texts of queries, and what they mean in SQL over a document's terms t.
_HAS = "list_contains(t, '{}')".format
_PHRASE = "contains(' ' || array_to_string(t, ' ') || ' ', ' {} ')".format
_ANY = "len(list_filter(t, lambda x: {})) > 0".format
TEXT_QUERIES = {
    "q_term": ("the", _HAS("the")),
    "q_and": ("the AND that", f"{_HAS('the')} AND {_HAS('that')}"),
    "q_or": ("nicht OR pour", f"{_HAS('nicht')} OR {_HAS('pour')}"),
    "q_not": ("the NOT that", f"{_HAS('the')} AND NOT {_HAS('that')}"),
    "q_pure_not": ("NOT the", f"NOT {_HAS('the')}"),
    "q_required": ("+the -that of", f"{_HAS('the')} AND NOT {_HAS('that')}"),
    "q_phrase": ('"of the"', _PHRASE("of the")),
    "q_prefix": ("th*", _ANY("starts_with(x, 'th')")),
    "q_wildcard": ("th??", _ANY("regexp_full_match(x, 'th..')")),
    "q_leading_wildcard": ("*tion", _ANY("ends_with(x, 'tion')")),
    "q_regex": ("/[st]h(e|at)+/", _ANY("regexp_full_match(x, '[st]h(e|at)+')")),
    "q_regex_alternatives": ("/.irst|p[ao]ir/", _ANY("regexp_full_match(x, '.irst|p[ao]ir')")),
    "q_regex_complement": ("/th.*&~(.*e.*)/", _ANY("starts_with(x, 'th') AND NOT contains(x, 'e')")),
    "q_regex_numbers": ("/<10-99>/", _ANY("regexp_full_match(x, '[1-9][0-9]')")),
    "q_regex_long_numbers": ("/<7-1200>/", _ANY("regexp_full_match(x, '[0-9]+') AND TRY_CAST(x AS HUGEINT) BETWEEN 7 AND 1200")),
    "q_infix": ("*ight*", _ANY("contains(x, 'ight')")),
    "q_range_incl": ("[that TO the]", _ANY("x >= 'that' AND x <= 'the'")),
    "q_range_excl": ("{that TO the}", _ANY("x > 'that' AND x < 'the'")),
    "q_range_mixed": ("[w TO with}", _ANY("x >= 'w' AND x < 'with'")),
    "q_range_open": ("[zu TO *]", _ANY("x >= 'zu'")),
    "q_fuzzy": ("idiot~1", _ANY("damerau_levenshtein(x, 'idiot') <= 1")),
    "q_fuzzy_two": ("idiot~2", _ANY("damerau_levenshtein(x, 'idiot') <= 2 AND damerau_levenshtein(x, 'idiot') < least(length(x), 5)")),
    "q_boolean_text": ("(the OR une) AND that && !of", f"({_HAS('the')} OR {_HAS('une')}) AND {_HAS('that')} AND NOT {_HAS('of')}"),
    "q_no_precedence": ("the AND that OR of", f"{_HAS('the')} AND {_HAS('that')}"),
    "q_nested_negative": ("the AND (NOT that)", f"{_HAS('the')} AND NOT {_HAS('that')}"),
    "q_field_group": ('content:("of the" OR nicht)', f"{_PHRASE('of the')} OR {_HAS('nicht')}"),
    "q_other_field": ("title:the", "false"),
    "q_match_all": ("*:*", "true"),
    "q_boost": ("the^3 AND that^0.5", f"{_HAS('the')} AND {_HAS('that')}"),
    "q_escaped": (r"\+the\?", _HAS("the")),
}


def _scan(text: str):
    return lambda spark, sf_dir: ScanEngine(docs(spark, sf_dir)).search(text, None).rows


def _indexed(text: str):
    return lambda spark, sf_dir: index(spark, sf_dir).search(text, None).rows


for _name, (_text, _where) in TEXT_QUERIES.items():
    QUERIES[_name] = _scan(_text)
    SQL[_name] = f"WITH {_lexed()} SELECT content_id FROM k WHERE {_where}"
for _name in ("q_term", "q_not", "q_pure_not", "q_phrase", "q_prefix", "q_leading_wildcard", "q_regex", "q_regex_alternatives", "q_regex_complement", "q_regex_numbers", "q_regex_long_numbers", "q_infix", "q_range_mixed", "q_fuzzy", "q_fuzzy_two", "q_boolean_text", "q_no_precedence"):
    QUERIES["index_" + _name[2:]] = _indexed(TEXT_QUERIES[_name][0])
    SQL["index_" + _name[2:]] = SQL[_name]

_SLOP = """, p AS (SELECT content_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM k)
SELECT DISTINCT a.content_id FROM p a JOIN p b USING (content_id) WHERE a.term = 'of' AND b.term = 'with' AND abs(b.pos - 1 - a.pos) <= 3"""


@query(f"WITH {_lexed()}{_SLOP}")
def q_phrase_slop(spark, sf_dir):
    return ScanEngine(docs(spark, sf_dir)).search('"of with"~3', None).rows


@query(f"WITH {_lexed()}{_SLOP}")
def index_phrase_slop(spark, sf_dir):
    return index(spark, sf_dir).search('"of with"~3', None).rows


@query(f"WITH {_lexed()} SELECT content_id FROM k WHERE {_HAS('the')} AND ({_HAS('that')} OR {_HAS('scum')}) AND NOT {_HAS('of')}")
def q_or_group(spark, sf_dir):
    b = Builder(Parser())
    built = b.boolean([(AND, b.value("the")), (OR, b.value("that")), (OR, b.value("scum")), (NOT, b.value("of"))])
    return ScanEngine(docs(spark, sf_dir)).search(built, None).rows


@query(f"WITH {_lexed()} SELECT content_id FROM k WHERE {_PHRASE('and the')} AND {_ANY('starts_with(x, ' + repr('wh') + ')')}")
def q_builder(spark, sf_dir):
    b = Builder(Parser())
    built = b.boolean([(AND, b.phrase("and", "the")), (AND, b.engine_specific("wh*"))])
    return ScanEngine(docs(spark, sf_dir)).search(built, None).rows


@query()
def q_syntax_errors(spark, sf_dir):
    """Queries that can't be parsed, and those with warnings."""
    parse = Parser()
    texts = ["phrase (", "", "a AND", "[a b]", "a~1.5", "NOT 1", "*warn", 'content: ("some phrase" OR *warn)', "fine"]
    rows = [(t, q.errors, q.warnings) for t in texts for q in [parse(t)]]
    return spark.createDataFrame(rows, "query string, errors array<string>, warnings array<string>")


_FILES = "f AS (SELECT doc_id AS content_id, source || '/' || doc_id || '.txt' AS path FROM documents)"


def _files(spark, sf_dir):
    rows = read(spark, sf_dir, "documents", "doc_id", "source")
    return rows.select(F.col("doc_id").alias("content_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"))


@query(f"WITH {_lexed()}, {_FILES} SELECT path, content_id FROM f JOIN k USING (content_id) WHERE {_HAS('moron')} ORDER BY upper(path)")
def search_files_join(spark, sf_dir):
    hits = ScanEngine(docs(spark, sf_dir)).search("moron", None).rows
    return files_of(hits, _files(spark, sf_dir)).select("path", "content_id").orderBy(F.upper("path"))


@query("SELECT sha256(text) AS content, min(doc_id) AS content_id, count(*) AS files, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents WHERE text IS NOT NULL GROUP BY text")
def search_shared_content(spark, sf_dir):
    """Files that share a content: the grouping of unique values."""
    rows = read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    groups = rows.groupBy(F.sha2("text", 256).alias("content")).agg(F.min("doc_id").alias("content_id"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return groups.select("content", "content_id", F.size("ids").cast("long").alias("files"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"WITH {_lexed()} SELECT content_id FROM k WHERE {_HAS('the')} ORDER BY content_id LIMIT 256")
def result_cap(spark, sf_dir):
    """A page of hits, in a fixed order."""
    return ScanEngine(docs(spark, sf_dir)).search("the", None).rows.orderBy("content_id").limit(256)


_RANK = f"""WITH {_lexed()}, p AS (SELECT content_id, unnest(t) AS term FROM k), n AS (SELECT count(*) AS n FROM documents),
tf AS (SELECT content_id, term, count(*) AS tf FROM p WHERE term IN ('moron', 'that') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), l AS (SELECT content_id, count(*) AS l FROM p GROUP BY content_id),
s AS (SELECT content_id, sum(sqrt(tf) * (1 + ln(n / (df + 1))) * (1 + ln(n / (df + 1)))) / any_value(sqrt(l)) AS score FROM tf JOIN df USING (term) JOIN l USING (content_id), n GROUP BY content_id)
SELECT content_id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, content_id LIMIT 20"""


@query(_RANK)
def ranked_hits(spark, sf_dir):
    scored = relevance(index(spark, sf_dir).tables(), ["moron", "that"])
    return top_hits(scored.withColumn("score", F.round("score", 9)), 20).withColumn("score", F.round("score", 6))


@query(f"WITH {_lexed()} SELECT content_id, count(DISTINCT term) AS terms FROM (SELECT content_id, unnest(t) AS term FROM k WHERE content_id % 3 <> 0 UNION ALL SELECT content_id, unnest(['replaced', 'content']) FROM k WHERE content_id % 3 = 0) GROUP BY content_id")
def upsert_replace(spark, sf_dir):
    """Postings after an update of an index that replaces every third document."""
    engine, rows = new_engine(spark), docs(spark, sf_dir)
    engine.update(rows)
    engine.update(rows.where(F.col("content_id") % 3 == 0).select("content_id", F.lit("Replaced content").alias("content")))
    return engine.tables().postings.groupBy("content_id").agg(F.count(F.lit(1)).alias("terms"))


@query(f"WITH {_lexed()} SELECT content_id, count(DISTINCT term) AS terms FROM (SELECT content_id, unnest(t) AS term FROM k WHERE content_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) GROUP BY content_id")
def remove_ids(spark, sf_dir):
    engine = new_engine(spark)
    engine.update(docs(spark, sf_dir))
    engine.remove(read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("content_id")))
    return engine.tables().postings.groupBy("content_id").agg(F.count(F.lit(1)).alias("terms"))


def _term_sql(word: str) -> str:
    return f"sqrt(len(list_filter(t, x -> x = '{word}'))) / sqrt(len(t)) * power(1 + ln((SELECT count(*) FROM k) / ((SELECT count(*) FROM k WHERE {_HAS(word)}) + 1)), 2)".replace("x -> ", "lambda x: ")


def _phrase_sql(a: str, b: str) -> str:
    times = f"len(list_filter(generate_series(1, len(t) - 1), lambda i: t[i] = '{a}' AND t[i + 1] = '{b}'))"
    idf = " + ".join(f"1 + ln((SELECT count(*) FROM k) / ((SELECT count(*) FROM k WHERE {_HAS(w)}) + 1))" for w in (a, b))
    return f"sqrt({times}) / sqrt(len(t)) * power({idf}, 2)"


# Queries ranked as whole trees: their text, which documents they hold for, and the score there.
RANKED_QUERIES = {
    "ranked_or": ("moron^2 OR that", f"{_HAS('moron')} OR {_HAS('that')}", f"2 * {_term_sql('moron')} + {_term_sql('that')}"),
    "ranked_phrase": ('+the^0.5 "of the"^3 -nicht', f"{_HAS('the')} AND NOT {_HAS('nicht')}", f"0.5 * {_term_sql('the')} + 3 * {_phrase_sql('of', 'the')}"),
    "ranked_nested": ("(nicht OR pour^4) AND (th* OR de^2)^0.5", f"({_HAS('nicht')} OR {_HAS('pour')}) AND ({_ANY('starts_with(x, ' + repr('th') + ')')} OR {_HAS('de')})",
        f"{_term_sql('nicht')} + 4 * {_term_sql('pour')} + 0.5 * (CASE WHEN {_ANY('starts_with(x, ' + repr('th') + ')')} THEN 1 ELSE 0 END + 2 * {_term_sql('de')})"),
}


def _ranked(text: str):
    return lambda spark, sf_dir: index(spark, sf_dir).search(text, 50, ranked=True).rows


for _name, (_text, _where, _score) in RANKED_QUERIES.items():
    QUERIES[_name] = _ranked(_text)
    SQL[_name] = f"WITH {_lexed()} SELECT content_id, round({_score}, 9) AS score FROM k WHERE {_where} ORDER BY score DESC, content_id LIMIT 50"


_DIFF = """WITH a AS (SELECT source || '/' || doc_id AS path, doc_id AS content_id, n_chars AS length, doc_id AS mtime FROM documents),
b AS (SELECT CASE WHEN doc_id % 7 = 1 THEN 'moved/' || doc_id ELSE source || '/' || doc_id END AS path,
  n_chars + (doc_id % 5 = 2)::INT AS length, doc_id AS mtime FROM documents WHERE doc_id % 11 <> 3
  UNION ALL SELECT 'new/' || doc_id, n_chars, -doc_id - 1 FROM documents WHERE doc_id % 13 = 0),
j AS (SELECT a.path AS p, b.path AS q, content_id, a.length AS l, b.length AS m, a.mtime AS t, b.mtime AS u FROM a FULL JOIN b ON upper(a.path) = upper(b.path)),
mv AS (SELECT g.p, c.q, g.content_id FROM (SELECT * FROM j WHERE q IS NULL) g JOIN (SELECT * FROM j WHERE p IS NULL) c ON g.l = c.m AND g.t = c.u),
fresh AS (SELECT q AS path, 'Created' AS change_type FROM j WHERE p IS NULL AND q NOT IN (SELECT q FROM mv)
  UNION ALL SELECT q, 'Changed' FROM j WHERE p IS NOT NULL AND q IS NOT NULL AND (l <> m OR t <> u))
SELECT path, change_type, NULL::VARCHAR AS old_path, (SELECT max(content_id) FROM a) + row_number() OVER (ORDER BY path) AS content_id FROM fresh
UNION ALL SELECT q, 'Renamed', p, content_id FROM mv
UNION ALL SELECT p, 'Deleted', NULL, content_id FROM j WHERE q IS NULL AND p NOT IN (SELECT p FROM mv)"""


@query(_DIFF)
def snapshot_diff(spark, sf_dir):
    rows = read(spark, sf_dir, "documents", "doc_id", "source", "n_chars")
    path = F.concat("source", F.lit("/"), "doc_id")
    before = rows.select(path.alias("path"), F.col("doc_id").alias("content_id"), F.col("n_chars").alias("length"), F.col("doc_id").alias("mtime"))
    moved = F.when(F.col("doc_id") % 7 == 1, F.concat(F.lit("moved/"), "doc_id")).otherwise(path)
    after = rows.where("doc_id % 11 <> 3").select(moved.alias("path"), (F.col("n_chars") + (F.col("doc_id") % 5 == 2).cast("int")).alias("length"), F.col("doc_id").alias("mtime"))
    new = rows.where("doc_id % 13 = 0").select(F.concat(F.lit("new/"), "doc_id").alias("path"), F.col("n_chars").alias("length"), (-F.col("doc_id") - 1).alias("mtime"))
    return mirror.snapshot_diff(before, after.unionByName(new))


_PLACES = f"""WITH w AS (SELECT doc_id AS content_id, unnest(regexp_extract_all(coalesce(text, ''), '{_WORD}', 0)) AS word,
  unnest(string_split_regex(coalesce(text, ''), '{_WORD}')[:-2]) AS gap, generate_subscripts(regexp_extract_all(coalesce(text, ''), '{_WORD}', 0), 1) AS pos FROM documents),
o AS (SELECT content_id, pos, lower(word) AS term, sum(length(word) + length(gap)) OVER (PARTITION BY content_id ORDER BY pos) - length(word) AS start, length(word) AS n FROM w)"""


@query(f"""{_PLACES}, l AS (SELECT content_id, start + n AS "end", max(CASE WHEN term = 'the' THEN start END) OVER s AS a, max(CASE WHEN term = 'that' THEN start END) OVER s AS b
  FROM o WHERE term IN ('the', 'that') WINDOW s AS (PARTITION BY content_id ORDER BY pos)),
r AS (SELECT content_id, least(a, b) AS start, "end", row_number() OVER (PARTITION BY content_id ORDER BY "end" - least(a, b), "end") AS k FROM l WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT content_id, start::INT AS start, "end"::INT AS "end" FROM r WHERE k = 1""")
def shortest_snippets(spark, sf_dir):
    """Where in each document the shortest stretch with both words is."""
    return snippets(docs(spark, sf_dir), ["the", "that"])


@query(f"{_PLACES} SELECT content_id, count(*) AS terms, sum(start)::BIGINT AS starts, max(start + n)::INT AS last FROM o GROUP BY content_id")
def term_offsets(spark, sf_dir):
    found = offsets(docs(spark, sf_dir))
    return found.groupBy("content_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("start").alias("starts"), F.max("end").alias("last"))


@query("""WITH r AS (SELECT event_id AS seq, user_id AS key, CASE WHEN event_type IN (SELECT min(event_type) FROM events) THEN 'Remove' ELSE 'Add' END AS op, CAST(floor(value) AS BIGINT) AS size FROM events WHERE user_id IS NOT NULL),
m AS (SELECT *, CASE WHEN op = lag(op) OVER k THEN 0 ELSE 1 END AS new FROM r WINDOW k AS (PARTITION BY key ORDER BY seq)),
g AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY seq) AS run FROM m),
q AS (SELECT key, any_value(op) AS op, min(seq) AS seq, max_by(size, seq) AS size FROM g WHERE run = (SELECT max(h.run) FROM g h WHERE h.key = g.key) GROUP BY key)
SELECT key, op, seq, size, row_number() OVER (ORDER BY op = 'Add', CASE WHEN op = 'Add' THEN size END NULLS FIRST, seq) AS place FROM q""")
def work_queue(spark, sf_dir):
    """Users as keys whose events ask for work: one kind of event for removal, the others for addition, by value."""
    events = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    kind = F.broadcast(events.agg(F.min("event_type").alias("_kind")))  # one row
    op = F.when(F.col("event_type") == F.col("_kind"), REMOVE).otherwise(ADD)
    requests = events.join(kind).select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), op.alias("op"), F.floor("value").cast("long").alias("size"))
    return work_order(pending(requests))


@query("""WITH a AS (SELECT lang || '/' || doc_id AS path, doc_id AS content_id, sha256(coalesce(text, '')) AS d FROM documents),
b AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'moved/' || doc_id ELSE lang || '/' || doc_id END AS path, sha256(coalesce(text, '')) AS d FROM documents WHERE doc_id % 5 <> 1),
g AS (SELECT path AS p, content_id, d, row_number() OVER (PARTITION BY d ORDER BY path) AS n FROM a WHERE path NOT IN (SELECT path FROM b)),
c AS (SELECT path AS q, d, row_number() OVER (PARTITION BY d ORDER BY path) AS n FROM b WHERE path NOT IN (SELECT path FROM a)),
mv AS (SELECT p, q, content_id FROM g JOIN c USING (d, n))
SELECT q AS path, 'Renamed' AS change_type, p AS old_path, content_id FROM mv
UNION ALL SELECT p, 'Deleted', NULL, content_id FROM g WHERE p NOT IN (SELECT p FROM mv)
UNION ALL SELECT q, 'Created', NULL, (SELECT max(content_id) FROM a) + row_number() OVER (ORDER BY q) FROM c WHERE q NOT IN (SELECT q FROM mv)""")
def snapshot_moves(spark, sf_dir):
    """Files with digests, many of them copies of each other, of which some move and some go: each one that came has one that went."""
    rows = read(spark, sf_dir, "documents", "doc_id", "lang", "text")
    path, digest = F.concat("lang", F.lit("/"), "doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)
    fixed = [F.lit(0).alias("length"), F.lit(0).alias("mtime"), digest.alias("digest")]
    before = rows.select(path.alias("path"), F.col("doc_id").alias("content_id"), *fixed)
    moved = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("moved/"), "doc_id")).otherwise(path)
    return mirror.snapshot_diff(before, rows.where("doc_id % 5 <> 1").select(moved.alias("path"), *fixed))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM m)
SELECT user_id, count(*) AS n_events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM g GROUP BY user_id, burst""")
def debounce_events(spark, sf_dir):
    events = read(spark, sf_dir, "events", "user_id", "ts").where("ts is not null and user_id is not null")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return debounced(events, "user_id", "30 minutes").select("user_id", "n_events", micros("first").alias("first_us"), micros("last").alias("last_us"))


@query("SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS place FROM documents ORDER BY n_chars, doc_id LIMIT 100")
def size_order(spark, sf_dir):
    """The next hundred tasks of a queue that takes small files first."""
    rows = read(spark, sf_dir, "documents", "doc_id", "n_chars").toDF("seq", "length")
    head = mirror.size_order(rows).limit(100)
    return head.select(F.col("seq").alias("doc_id"), F.col("length").alias("n_chars"), F.row_number().over(Window.orderBy("length", "seq")).cast("long").alias("place"))


@query("SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars NULLS FIRST, doc_id NULLS FIRST) AS place FROM documents")
def size_places(spark, sf_dir):
    """The place of every task in that queue."""
    rows = read(spark, sf_dir, "documents", "doc_id", "n_chars").toDF("seq", "length")
    return mirror.size_places(rows).select(F.col("seq").alias("doc_id"), F.col("length").alias("n_chars"), "place")


_URL = "regexp_replace(url, '^[a-z]+:/', '')"


@query(f"""WITH p AS (SELECT page_id, {_URL} AS path FROM pages), t AS (SELECT DISTINCT upper(regexp_extract(path, '^/[^/]*')) AS d FROM p WHERE page_id % 10 = 0)
SELECT page_id, path FROM p WHERE EXISTS (SELECT 1 FROM t WHERE upper(path) = d OR starts_with(upper(path), d || '/'))""")
def path_ancestors_watched(spark, sf_dir):
    pages = read(spark, sf_dir, "pages", "page_id", "url").select("page_id", F.regexp_replace("url", "^[a-z]+:/", "").alias("path"))
    targets = pages.where("page_id % 10 = 0").select(F.lit(mirror.DIRECTORY).alias("type"), F.regexp_extract("path", "^/[^/]*", 0).alias("path"))
    return mirror.watched(pages.withColumn("entry_type", F.lit(mirror.FILE)), targets).select("page_id", "path")


@query(f"WITH p AS (SELECT {_URL} AS path FROM pages) SELECT regexp_replace(path, '/[^/]*$', '') AS parent, 0::BIGINT AS directories, count(*) AS files, 0::BIGINT AS unclassified FROM p GROUP BY 1")
def child_counts(spark, sf_dir):
    pages = read(spark, sf_dir, "pages", "url").select(F.regexp_replace("url", "^[a-z]+:/", "").alias("path"), F.lit(mirror.FILE).alias("entry_type"))
    return mirror.child_counts(pages)


@query("SELECT doc_id, regexp_matches(text, '[\\x{1100}-\\x{11FF}\\x{2E80}-\\x{2EFF}\\x{3000}-\\x{9FFF}\\x{A960}-\\x{A97F}\\x{AC00}-\\x{D7FF}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE4F}\\x{FF00}-\\x{FFEF}]') AS cjk FROM documents WHERE text IS NOT NULL")
def cjk_flag(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", has_cjk(F.col("text")).alias("cjk"))


_SPECIALS = r"([&|+\-!(){}\[\]^\"~*?:\\/])"


@query(f"SELECT page_id, regexp_replace(url, '{_SPECIALS}', '\\\\\\1', 'g') AS escaped, url AS unescaped FROM pages")
def escape_text(spark, sf_dir):
    escaped = read(spark, sf_dir, "pages").select("page_id", fn.escape_query(F.col("url")).alias("escaped"))
    return escaped.withColumn("unescaped", fn.unescape_query(F.col("escaped")))


@query("""SELECT o_orderkey, CASE WHEN ms > 172800000 THEN (ms // 86400000)::VARCHAR || 'd' WHEN ms > 7200000 THEN (ms // 3600000)::VARCHAR || 'h'
  WHEN ms > 120000 THEN (ms // 60000)::VARCHAR || 'm' WHEN ms > 2000 THEN (ms // 1000)::VARCHAR || 's' ELSE ms::VARCHAR || 'ms' END || ' ago' AS status
FROM (SELECT o_orderkey, o_orderkey * 977 AS ms FROM orders)""")
def scan_status(spark, sf_dir):
    ms = F.col("o_orderkey").cast("long") * 977
    return read(spark, sf_dir, "orders").select("o_orderkey", fn.scan_status(F.lit(0), F.lit(0), ms).alias("status"))


@query("SELECT source || '/' || doc_id AS path, 'src' || '/' || doc_id AS joined, len(string_split(source || '/' || doc_id, '/'))::INT AS depth FROM documents")
def path_functions(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("\\"), "doc_id").alias("w"))
    parts = fn.path_parts(F.col("w"))
    joined = fn.path_join(F.array(F.lit("src"), F.element_at(parts, -1)))
    return rows.select(fn.path_join(parts).alias("path"), joined.alias("joined"), F.size(parts).alias("depth"))


@query("SELECT content, min(finished_ms) FILTER (never = 0) AS finished_ms FROM (SELECT sha256(text) AS content, CASE WHEN doc_id % 4 <> 0 THEN doc_id * 10 END AS finished_ms, max((doc_id % 4 = 0)::INT) OVER (PARTITION BY text) AS never FROM documents WHERE text IS NOT NULL) GROUP BY content")
def shared_scan_times(spark, sf_dir):
    rows = read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    files = rows.select(F.sha2("text", 256).alias("content_id"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") * 10).alias("finished_ms"))
    return mirror.scan_times(files).withColumnRenamed("content_id", "content")


@query("SELECT arg_max(event_id, event_id) AS seq, user_id FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def latest_events(spark, sf_dir):
    events = read(spark, sf_dir, "events", "event_id", "user_id").where("user_id is not null")
    return mirror.latest_events(events.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("path"), "user_id")).select("seq", "user_id")


@query()
def tree_print(spark, sf_dir):
    """The pages' paths as a printed tree, in order, with a mark on hits."""
    pages = read(spark, sf_dir, "pages", "url").select(F.regexp_replace("url", "^[a-z]+:/", "").alias("path")).distinct()
    ups = pages.select(F.explode(fn.path_ancestors(F.col("path"))).alias("up"), "path").where("up <> path").select(F.col("up").alias("path")).distinct()
    entries = pages.withColumn("entry_type", F.lit(mirror.FILE)).unionByName(ups.join(pages, "path", "left_anti").withColumn("entry_type", F.lit(mirror.DIRECTORY)))
    mark = F.when(F.col("path").rlike("1"), " *match*").otherwise("")
    return mirror.tree_lines(entries, mark).orderBy("key").select("line")


@query()
def tolerant_tokens(spark, sf_dir):
    """Tokens of every document's whole text, taken as a query."""

    @F.udf("array<struct<pos:int,value:string,type:string,parent_field:string,style:string>>")
    def tokens(text):
        return [(t.position, t.value, t.type, t.parent_field, highlight(t)) for t in tokenize(text)[0]]

    texts = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.select("doc_id", F.inline(tokens("text")))


@query()
def edited_tokens(spark, sf_dir):
    """The token under a caret in the middle of every document's whole text."""

    @F.udf("struct<pos:int,value:string,type:string,parent_field:string>")
    def under(text):
        t = edited_token(text, len(text) // 2)
        return t.position, t.value, t.type, t.parent_field

    texts = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.select("doc_id", under("text").alias("t")).select("doc_id", "t.*")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ScanEngine(docs(spark, sf_dir)).search('the AND NOT "of the"', None).rows.orderBy("content_id")


QUERIES["flagship"] = flagship
SQL["flagship"] = f"WITH {_lexed()} SELECT content_id FROM k WHERE {_HAS('the')} AND NOT {_PHRASE('of the')}"
