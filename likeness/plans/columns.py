"""Registered queries on column catalogs.

The catalogs grow with the data: every document is a table whose columns are its words, and
every pair of neighbouring words links two tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import random as R
from ..functions import text as X
from ..operators import catalog as C
from ..operators import graph as G
from ..operators import pii
from ..operators.joins import shuffle_width, skew_join
from ..session import cut_lineage
from .common import load, sql_below, sql_pick, sql_u

SUFFIXES = ["_id", "_name", "_email", "_date", "_price", "_category", "_type", "_city", "_state", "_country", "_cost", "_subcategory", "_phone", "_flag", "", "Id"]
TYPES = ["INTEGER", "VARCHAR(20)", "decimal(10,2)", "timestamp with time zone", "text", "DOUBLE  PRECISION", "bool", "Date", "character varying (9)", "blob"]


def words(spark, d, dealt: bool = False) -> DataFrame:
    """(doc_id, source, position, word) of every document, whole texts.

    ``dealt`` shuffles the texts by doc_id before they are split, so that whatever groups or joins words by document needs no
    shuffle of the words, which are several times as large; words without a doc_id are left out.
    """
    docs = load(spark, d, "documents").where("doc_id IS NOT NULL") if dealt else load(spark, d, "documents", "doc_id")
    docs = docs.repartition(shuffle_width(docs), "doc_id") if dealt else docs
    split = docs.select("doc_id", "source", F.posexplode(F.split(F.lower("text"), "[^a-z]+")).alias("position", "word"))
    return split.where("word <> ''")


WORDS_SQL = """words AS (SELECT doc_id, source, pos AS position, word FROM (
  SELECT doc_id, source, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos
  FROM (SELECT doc_id, source, string_split_regex(lower(text), '[^a-z]+') AS w FROM documents)) WHERE word <> '')"""


def doc_columns(spark, d) -> DataFrame:
    """Catalog: one table per document, one column per different word."""
    firsts = words(spark, d).groupBy("doc_id", "word").agg(F.min("position").alias("position"))
    catalog = firsts.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("table_name"), "position",
        F.concat("word", R.pick(SUFFIXES, R.below(7, "suffix", "word", len(SUFFIXES)))).alias("column_name"),
        R.pick(TYPES, R.below(7, "type", "word", len(TYPES))).alias("data_type"),
        (R.below(7, "null", "word", 2) == 1).alias("is_nullable"), F.lit(False).alias("is_pk"),
    )
    return cut_lineage(catalog)


DOC_COLUMNS_SQL = f"""{WORDS_SQL},
cols AS (SELECT 'doc_' || doc_id AS table_name, min(position) AS position,
  word || {sql_pick(SUFFIXES, sql_below(7, 'suffix', 'word', len(SUFFIXES)))} AS column_name,
  {sql_pick(TYPES, sql_below(7, 'type', 'word', len(TYPES)))} AS data_type,
  {sql_below(7, 'null', 'word', 2)} = 1 AS is_nullable FROM words GROUP BY doc_id, word)"""


def column_names(spark, d) -> DataFrame:
    """The different (column_name, data_type) of the document catalog."""
    w = words(spark, d).select("word").distinct()
    return w.select(
        F.concat("word", R.pick(SUFFIXES, R.below(7, "suffix", "word", len(SUFFIXES)))).alias("column_name"),
        R.pick(TYPES, R.below(7, "type", "word", len(TYPES))).alias("data_type"),
    )


NAMES_SQL = f"WITH {DOC_COLUMNS_SQL}, names AS (SELECT DISTINCT column_name, data_type FROM cols)"


def word_links(spark, d) -> DataFrame:
    """Catalog: one table per word, one ``{next word}_id`` column per neighbour, and a key column."""
    docs = load(spark, d, "documents", "doc_id")
    arr = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    pairs = docs.select(arr.alias("w")).where("size(w) > 1").select(
        F.explode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("a"), F.expr("slice(w, 2, size(w) - 1)").alias("b"))).alias("p")
    )
    links = cut_lineage(pairs.select(F.col("p.a").alias("table_name"), F.concat("p.b", F.lit("_id")).alias("column_name")).distinct())
    links = links.select("table_name", "column_name", F.lit(1).alias("position"), (R.below(7, "null", "column_name", 2) == 1).alias("is_nullable"), F.lit(False).alias("is_pk"))
    tables = links.select("table_name").distinct()
    kind = R.below(7, "pk", "table_name", 3)
    keys = tables.select(
        "table_name", F.when(kind == 0, F.lit("id")).when(kind == 1, F.concat("table_name", F.lit("Id"))).otherwise(F.lit("code")).alias("column_name"),
        F.lit(0).alias("position"), F.lit(False).alias("is_nullable"), (kind == 2).alias("is_pk"),
    )
    return cut_lineage(keys.unionByName(links))


LINKS_SQL = f"""arrs AS (SELECT list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents),
links AS (SELECT DISTINCT a AS table_name, b || '_id' AS column_name FROM (SELECT unnest(w[1:len(w) - 1]) AS a, unnest(w[2:len(w)]) AS b FROM arrs WHERE len(w) > 1)),
cols AS (SELECT table_name, column_name, 1 AS position, {sql_below(7, 'null', 'column_name', 2)} = 1 AS is_nullable, false AS is_pk FROM links
  UNION ALL SELECT table_name, CASE k WHEN 0 THEN 'id' WHEN 1 THEN table_name || 'Id' ELSE 'code' END, 0, false, k = 2
  FROM (SELECT table_name, {sql_below(7, 'pk', 'table_name', 3)} AS k FROM (SELECT DISTINCT table_name FROM links)))"""

TIGHT = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


def _singular_sql(x: str) -> str:
    return f"""CASE WHEN {x} LIKE '%ies' AND length({x}) > 3 THEN substr({x}, 1, length({x}) - 3) || 'y'
      WHEN {x} LIKE '%ses' AND length({x}) > 3 THEN substr({x}, 1, length({x}) - 2)
      WHEN {x} LIKE '%s' AND length({x}) > 1 THEN substr({x}, 1, length({x}) - 1) ELSE {x} END"""


# rank 0 flagged, 1 id, 2 {table}id, 3 first column
PKS_SQL = f"""pks AS (SELECT table_name, arg_min(column_name, r * 1000000 + position) AS pk_column FROM (
  SELECT *, CASE WHEN is_pk THEN 0 WHEN column_name = 'id' THEN 1
    WHEN {TIGHT.format('column_name')} IN (table_name || 'id', ({_singular_sql('table_name')}) || 'id') THEN 2 ELSE 3 END AS r FROM cols)
  GROUP BY table_name)"""


def pk_pick(spark, d):
    return C.pick_keys(word_links(spark, d))


def fk_by_name(spark, d):
    cols = word_links(spark, d)
    return C.infer_links(cols)


FK_BY_NAME_SQL = f"""WITH {LINKS_SQL}, {PKS_SQL},
child AS (SELECT table_name AS from_table, column_name AS from_column, is_nullable AS is_optional,
  substr({TIGHT.format('column_name')}, 1, length({TIGHT.format('column_name')}) - 2) AS stem FROM cols WHERE {TIGHT.format('column_name')} LIKE '%_id' AND length({TIGHT.format('column_name')}) > 2),
parent AS (SELECT DISTINCT table_name AS to_table, pk_column AS to_column, unnest([table_name, {_singular_sql('table_name')}, table_name || 's']) AS stem FROM pks)
SELECT from_table, from_column, to_table, to_column, bool_or(is_optional) AS is_optional, '1:N' AS cardinality, 0.62::DOUBLE AS confidence
FROM child JOIN parent USING (stem) WHERE from_table <> to_table GROUP BY ALL"""


# --- names and types -----------------------------------------------------------------


def pii_names(spark, d):
    n = column_names(spark, d).select(F.col("column_name").alias("column"))
    contains, token = pii.name_signal("column"), pii.name_signal("column", "token")
    return n.select("column", contains["pii_type"].alias("pii_type"), contains["score"].alias("score"), token["pii_type"].alias("pii_type_token"))


def _pii_name_case(pattern: str, out: str) -> str:
    rules = []
    for kind, score, hints in pii.NAME_HINTS:
        rx = pattern.format("|".join(hints))
        rules.append(f"WHEN regexp_matches(n, '{rx}') THEN {repr(score) + '::DOUBLE' if out == 'score' else repr(kind)}")
    return f"CASE {' '.join(rules)} ELSE {'0.0::DOUBLE' if out == 'score' else repr('unknown')} END"


PII_NAMES_SQL = f"""{NAMES_SQL} SELECT column_name AS "column", {_pii_name_case('{0}', 'kind')} AS pii_type, {_pii_name_case('{0}', 'score')} AS score,
{_pii_name_case('(^|_)({0})(_|$)', 'kind')} AS pii_type_token
FROM (SELECT column_name, trim(regexp_replace(lower(column_name), '[^a-z0-9_]+', '_', 'g'), '_') AS n FROM names)"""


def semantic_types(spark, d):
    return C.infer_semantics(column_names(spark, d)).withColumn("normal_type", C.normal_type("data_type")).withColumn("type_generator", C.type_generator("data_type"))


_NORMAL = {"INTEGER": "integer", "VARCHAR(20)": "varchar", "decimal(10,2)": "decimal", "timestamp with time zone": "timestamp", "text": "text",
           "DOUBLE  PRECISION": "double", "bool": "boolean", "Date": "date", "character varying (9)": "varchar", "blob": "varchar"}
SEMANTIC_RULES = [
    ("email", "email", "categorical", 1), ("phone|mobile|contact", "phone", "categorical", 1), ("name", "person_name", "categorical", 1),
    ("address|street|zipcode|postal|postcode", "address", "categorical", 1),
    ("amount|amt|price|cost|revenue|income|salary|invoice", "currency", "numerical", 0), ("dob|birth", "birth_date", "datetime", 1),
    ("date|time|timestamp|created|updated", "datetime", "datetime", 0), ("^is_|^has_|flag", "boolean", "categorical", 0), ("_id$|^id$|uuid", "identifier", "categorical", 0),
]


def _semantic_case(col: int) -> str:
    def v(x):
        return f"'{x}'" if col < 3 else ("true" if x else "false")

    rules = [f"WHEN regexp_matches(lower(column_name), '{r[0]}') THEN {v(r[col])}" for r in SEMANTIC_RULES]
    t = {1: ("'datetime'", "'numeric'", "'categorical'"), 2: ("'datetime'", "'numerical'", "'categorical'"), 3: ("false", "false", "false")}[col]
    rules += [f"WHEN regexp_matches(upper(data_type), 'DATE|TIME') THEN {t[0]}", f"WHEN regexp_matches(upper(data_type), 'INT|NUM|DEC|DOUBLE|FLOAT|REAL') THEN {t[1]}"]
    return f"CASE {' '.join(rules)} ELSE {t[2]} END"


SEMANTIC_SQL = f"""{NAMES_SQL} SELECT column_name, data_type, {_semantic_case(1)} AS semantic_type, {_semantic_case(2)} AS generator_type,
{_semantic_case(3)} AS is_pii, 0.55::DOUBLE AS confidence,
CASE data_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _NORMAL.items())} END AS normal_type,
CASE WHEN regexp_matches(upper(data_type), 'DATE|TIME') THEN 'datetime' WHEN contains(upper(data_type), 'INT') THEN 'integer'
 WHEN regexp_matches(upper(data_type), 'NUM|DEC|DOUBLE|FLOAT|REAL') THEN 'numerical' ELSE 'categorical' END AS type_generator FROM names"""


def associations(spark, d):
    return C.associations(doc_columns(spark, d), 12)


def _first_sql(tokens: list[str]) -> str:
    return "coalesce(" + ", ".join(f"arg_min(column_name, position) FILTER (WHERE contains(lower(column_name), '{t}'))" for t in tokens) + ")"


_RULE_ROWS = " UNION ALL ".join(
    f"SELECT table_name, {100000 + i} AS o, l{i} AS col_a, r{i} AS col_b, '{kind}' AS association, {conf}::DOUBLE AS confidence FROM firsts WHERE l{i} IS NOT NULL AND r{i} IS NOT NULL"
    for i, (_, _, kind, conf) in enumerate(C.ASSOCIATION_RULES)
)
ASSOCIATIONS_SQL = f"""WITH {DOC_COLUMNS_SQL},
firsts AS (SELECT table_name, {', '.join(f"{_first_sql(a)} AS l{i}, {_first_sql(b)} AS r{i}" for i, (a, b, _, _) in enumerate(C.ASSOCIATION_RULES))} FROM cols GROUP BY table_name),
ids AS (SELECT table_name, column_name, row_number() OVER (PARTITION BY table_name ORDER BY position) AS r FROM cols WHERE lower(column_name) LIKE '%\\_id' ESCAPE '\\'),
pairs AS (SELECT a.table_name, a.r * 200 + b.r AS o, a.column_name AS col_a, b.column_name AS col_b, 'identifier' AS association, 0.68::DOUBLE AS confidence
  FROM ids a JOIN ids b ON a.table_name = b.table_name AND a.r < b.r AND b.r <= 13),
every AS (SELECT * FROM pairs UNION ALL {_RULE_ROWS}),
once AS (SELECT *, row_number() OVER (PARTITION BY table_name, least(col_a, col_b), greatest(col_a, col_b) ORDER BY o) AS k FROM every)
SELECT table_name, col_a, col_b, association, confidence, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY o) AS rank FROM once WHERE k = 1) WHERE rank <= 12"""


# --- category expansion --------------------------------------------------------------

EXPAND_NAMES = ["gender", "customer_sex", "Education Level", "marital", "job_status", "order_state", "severity", "category", "segment", "notes"]
EXPAND_SEEDS = ["m; Female", "male, OTHER", "PhD\nmasters", "single, Divorced, single", "full time, Contract", "Pending", "low, high, urgent", "home, Toys", "A|3, B|1", " , ;"]


def category_expand(spark, d):
    """One column setting per customer; the market segment is an extra seed."""
    cust = load(spark, d, "customer")
    cols = cust.select(
        "c_custkey", R.pick(EXPAND_NAMES, R.below(5, "name", "c_custkey", len(EXPAND_NAMES))).alias("column_name"),
        F.concat(R.pick(EXPAND_SEEDS, R.below(5, "seeds", "c_custkey", len(EXPAND_SEEDS))), F.lit(", "), F.initcap("c_mktsegment")).alias("allowed_values"),
        R.pick(["auto", "Categorical", "integer"], R.below(5, "gen", "c_custkey", 3)).alias("generator_type"),
        R.pick(["varchar", "int"], R.below(5, "type", "c_custkey", 2)).alias("data_type"),
        (R.below(5, "flag", "c_custkey", 4) > 0).alias("expand_categories"),
    )
    return C.expand_categories(cols, 6).select("c_custkey", "column_name", "expanded_values")


def _family_sql() -> str:
    rows = []
    for pos, (name, hints, values, aliases) in enumerate(C.FAMILIES):
        for v in values:
            rows.append((pos, C._plain(v), v))
        for a, v in aliases.items():
            rows.append((pos, C._plain(a), v))
    toks = ", ".join(f"({p}, '{t}', '{v}')" for p, t, v in rows)
    hints_ = ", ".join(f"({p}, '{'|'.join(C._plain(h) for h in f[1])}', {'[' + ', '.join(repr(v) for v in f[2]) + ']'})" for p, f in enumerate(C.FAMILIES))
    return f"tok(fam, token, canon) AS (VALUES {toks}), fam(fam, hint, vals) AS (VALUES {hints_})"


CATEGORY_SQL = f"""WITH {_family_sql()},
cfg AS (SELECT c_custkey, {sql_pick(EXPAND_NAMES, sql_below(5, 'name', 'c_custkey', len(EXPAND_NAMES)))} AS column_name,
  {sql_pick(EXPAND_SEEDS, sql_below(5, 'seeds', 'c_custkey', len(EXPAND_SEEDS)))} || ', ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS vals,
  lower({sql_pick(['auto', 'Categorical', 'integer'], sql_below(5, 'gen', 'c_custkey', 3))}) AS gen,
  {sql_pick(['varchar', 'int'], sql_below(5, 'type', 'c_custkey', 2))} AS dt, {sql_below(5, 'flag', 'c_custkey', 4)} > 0 AS flag FROM customer),
raw AS (SELECT c_custkey, column_name, i, trim(s) AS s FROM (
  SELECT *, unnest(string_split_regex(vals, '[\\n,;]+')) AS s, generate_subscripts(string_split_regex(vals, '[\\n,;]+'), 1) AS i FROM cfg
  WHERE flag AND (gen = 'categorical' OR (gen = 'auto' AND dt = 'varchar'))) WHERE trim(s) <> ''),
seeds AS (SELECT c_custkey, column_name, s, min(i) AS i, {TIGHT.format('s')} AS t FROM raw GROUP BY ALL),
many AS (SELECT c_custkey, column_name, count(*) AS n FROM seeds GROUP BY ALL HAVING count(*) >= 2),
score AS (SELECT m.c_custkey, f.fam, (SELECT count(DISTINCT s.t) FROM seeds s JOIN tok k ON k.fam = f.fam AND k.token = s.t WHERE s.c_custkey = m.c_custkey)
   + CASE WHEN regexp_matches({TIGHT.format('m.column_name')}, f.hint) THEN 2 ELSE 0 END AS sc FROM many m, fam f),
best AS (SELECT c_custkey, arg_max(fam, sc * 100 - fam) AS fam, max(sc) AS sc FROM score GROUP BY c_custkey),
items AS (
  SELECT s.c_custkey, s.column_name, coalesce(CASE WHEN b.sc > 0 AND m.n < 6 THEN k.canon END, s.s) AS v, s.i FROM seeds s JOIN many m USING (c_custkey) JOIN best b USING (c_custkey)
    LEFT JOIN tok k ON k.fam = b.fam AND k.token = s.t
  UNION ALL SELECT m.c_custkey, m.column_name, unnest(f.vals), 1000 + generate_subscripts(f.vals, 1) FROM many m JOIN best b USING (c_custkey) JOIN fam f USING (fam) WHERE b.sc > 0 AND m.n < 6),
firsts AS (SELECT c_custkey, column_name, v, min(i) AS i FROM items GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY i) AS r FROM firsts)
SELECT c_custkey, column_name, string_agg(v, ', ' ORDER BY r) AS expanded_values FROM numbered WHERE r <= 6 GROUP BY ALL"""


# --- PII by values -------------------------------------------------------------------


def pii_token_hits(spark, d):
    tokens = load(spark, d, "documents", "doc_id").select("lang", F.explode(F.split("text", r"\s+")).alias("v")).where("v <> ''")
    return tokens.groupBy("lang").agg(F.count(F.lit(1)).alias("tokens"), *[F.count_if(t).alias(k) for k, t in pii.value_tests(F.col("v")).items()])


PII_TOKENS_SQL = f"""SELECT lang, count(*) AS tokens, count_if(regexp_matches(v, '{pii.EMAIL}')) AS email,
count_if(regexp_matches(v, '{pii.PHONE}') AND length(regexp_replace(v, '\\D+', '', 'g')) >= 10) AS phone,
count_if(regexp_matches(v, '{pii.SSN}')) AS ssn, count_if(regexp_matches(v, '{pii.CARD}')) AS card
FROM (SELECT lang, unnest(string_split_regex(text, '\\s+')) AS v FROM documents) WHERE v <> '' GROUP BY lang"""

_CONTACT = {  # column -> (Spark SQL, DuckDB SQL) over the draws d1, d2
    "email": "concat('u', c_custkey, '@', lower(c_mktsegment), '.com')",
    "contact_no": "concat('+1 ', d1, '-555-', d2)",
    "national": "concat(d1, '-', n2, '-', d2)",
    "payment": "concat(d2, d1, d2, d1, n2)",
    "remark": "concat('note ', d1)",
    "mixed": "CASE WHEN pick < 0.3 THEN concat('u', d1, '@example.org') WHEN pick < 0.5 THEN concat(' ', d1, '-', n2, '-', d2) ELSE '  ' END",
}


def contacts(spark, d) -> DataFrame:
    """Customers with typed contact columns, some of them null or blank."""
    cust = load(spark, d, "customer")
    draws = cust.withColumns(
        {
            "d1": (R.below(3, "d1", "c_custkey", 900) + 100).cast("string"),
            "d2": (R.below(3, "d2", "c_custkey", 9000) + 1000).cast("string"),
            "n2": (R.below(3, "n2", "c_custkey", 90) + 10).cast("string"),
            "pick": R.u(3, "pick", "c_custkey"),
        }
    )
    cols = {n: F.when(R.u(3, f"{n}.null", "c_custkey") >= 0.1, F.expr(e)) for n, e in _CONTACT.items()}
    return draws.withColumns(cols).select("c_custkey", "c_name", "c_acctbal", *cols)


CONTACTS_SQL = f"""contacts AS (SELECT c_custkey, c_name, c_acctbal, {', '.join(f"CASE WHEN {sql_u(3, n + '.null', 'c_custkey')} >= 0.1 THEN {e} END AS {n}" for n, e in _CONTACT.items())}
FROM (SELECT *, CAST({sql_below(3, 'd1', 'c_custkey', 900)} + 100 AS VARCHAR) AS d1, CAST({sql_below(3, 'd2', 'c_custkey', 9000)} + 1000 AS VARCHAR) AS d2,
 CAST({sql_below(3, 'n2', 'c_custkey', 90)} + 10 AS VARCHAR) AS n2, {sql_u(3, 'pick', 'c_custkey')} AS pick FROM customer))"""


def pii_columns(spark, d):
    return pii.detect(contacts(spark, d))


def _pii_columns_sql() -> str:
    cols = ["c_custkey", "c_name", "c_acctbal", *_CONTACT]
    hits = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", trim(CAST({c} AS VARCHAR)) AS v FROM contacts" for c in cols)
    return f"""WITH {CONTACTS_SQL}, vals AS ({hits}),
    h AS (SELECT "column", greatest(count_if(v <> ''), 1)::DOUBLE AS tot, count_if(regexp_matches(v, '{pii.EMAIL}')) AS e,
      count_if(regexp_matches(v, '{pii.PHONE}') AND length(regexp_replace(v, '\\D+', '', 'g')) >= 10) AS p,
      count_if(regexp_matches(v, '{pii.SSN}')) AS s, count_if(regexp_matches(v, '{pii.CARD}')) AS c FROM vals GROUP BY "column"),
    r AS (SELECT *, greatest(e, p, s, c) / tot AS best, CASE greatest(e, p, s, c) WHEN e THEN 'email' WHEN p THEN 'phone' WHEN s THEN 'ssn' ELSE 'card' END AS kind FROM h),
    q AS (SELECT "column", CASE WHEN best >= 0.25 THEN least(0.98, 0.55 + best * 0.45) ELSE 0.0 END AS rs, CASE WHEN best >= 0.25 THEN kind ELSE 'unknown' END AS rk,
      {_pii_name_case('{0}', 'score')} AS ns, {_pii_name_case('{0}', 'kind')} AS nk FROM (SELECT *, lower("column") AS n FROM r))
    SELECT "column", greatest(ns, rs) >= 0.6 AS is_pii, CASE WHEN ns >= rs THEN nk ELSE rk END AS pii_type, round(greatest(ns, rs), 4) AS confidence,
    round(ns, 4) AS name_score, round(rs, 4) AS regex_score, 0.0 AS ner_score FROM q"""


def pii_entities(spark, d):
    """The tagger hook with a plain rule tagger: capitalised tokens count as places."""

    def tagger(texts):
        return [{"GPE"} if t[:1].isupper() and not t[1:].isupper() else set() for t in texts]

    docs = load(spark, d, "documents", "doc_id").select("doc_id", F.col("lang").alias("topic"), F.initcap("source").alias("origin"))
    return pii.detect(docs, ["topic", "origin"], tagger=tagger, ids=["doc_id"])


# --- model replies -------------------------------------------------------------------

_REPLY_BODY = """concat('{"suggestions": [{"column_id": "', doc_id, '-a", "semantic_type": "', lang, '", "generator_type": "Categorical", "allowed_values": ["x", " y", "x"], "is_pii": true, "confidence": ', n_chars, 'e-3},
 {"column_id": "', doc_id, '-b", "confidence": "high", "allowed_values": "p; q,p"}, {"column_id": "nobody", "confidence": 1}]}')"""
_REPLY = f"""CASE kind WHEN 0 THEN concat('```json\n', {_REPLY_BODY}, '\n```') WHEN 1 THEN concat('Here it is: ', {_REPLY_BODY}, ' - done') WHEN 2 THEN concat('{{"suggestions": [', lang) ELSE {_REPLY_BODY} END"""


def _reply_frames(spark, d):
    docs = load(spark, d, "documents", "doc_id").withColumn("kind", R.below(9, "reply", "doc_id", 4))
    replies = docs.select(F.col("doc_id").alias("batch_id"), F.expr(_REPLY.replace("\n", "\\n")).alias("reply"))
    cols = docs.select(
        F.col("doc_id").alias("batch_id"), F.concat(F.lit("doc_"), F.col("doc_id")).alias("table_name"),
        F.explode(
            F.array(
                *[
                    F.struct(F.concat(F.col("doc_id"), F.lit("-" + k)).alias("column_id"), F.concat("source", F.lit(s)).alias("column_name"), F.lit(t).alias("data_type"), F.lit(v).alias("allowed_values"))
                    for k, s, t, v in (("a", "_email", "varchar", "old"), ("b", "_date", "DATE", "old"), ("c", "_id", "int", " r ,s"))
                ]
            )
        ).alias("c"),
    ).select("batch_id", "table_name", "c.*")
    return replies, cols


def expansion_clean(spark, d):
    """Model replies that repeat the seeds in other spellings, bring new values and blanks, or cannot be read."""
    docs = load(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    reply = F.expr("""CASE WHEN doc_id % 5 = 0 THEN 'no idea' ELSE concat('Sure: {"values": [" ', upper(lang), '", "x', doc_id % 7, '", " ", "', source, '"]} done') END""")
    return C.clean_expansions(docs.select("doc_id", F.concat_ws(", ", "lang", "source").alias("allowed_values"), reply.alias("reply"))).select("doc_id", "expanded_values")


EXPANSION_SQL = """SELECT doc_id, lang || ', ' || source || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ', x' || (doc_id % 7) END AS expanded_values FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL"""


def suggestion_clean(spark, d):
    return C.clean_suggestions(*_reply_frames(spark, d))


SUGGESTION_SQL = f"""WITH docs AS (SELECT *, {sql_below(9, 'reply', 'doc_id', 4)} AS kind FROM documents),
replies AS (SELECT doc_id AS batch_id, {_REPLY.replace(chr(10) + '```', "' || chr(10) || '```").replace('json' + chr(10), "json' || chr(10) || '")} AS reply FROM docs),
bare AS (SELECT batch_id, trim(CASE WHEN starts_with(reply, '```') THEN regexp_replace(regexp_replace(reply, '^```[a-zA-Z]*\\s*', ''), '\\s*```$', '') ELSE reply END) AS b FROM replies),
obj AS (SELECT batch_id, CASE WHEN json_valid(b) THEN b ELSE regexp_extract(b, '(?s)\\{{.*\\}}') END AS j FROM bare),
sug AS (SELECT batch_id, unnest(json_extract(j, '$.suggestions[*]')) AS s FROM obj WHERE json_valid(j) AND starts_with(j, '{{')),
given AS (SELECT batch_id, s->>'$.column_id' AS column_id, s->>'$.semantic_type' AS st, s->>'$.generator_type' AS gt, s->'$.allowed_values' AS av, s->>'$.is_pii' AS pii, try_cast(s->>'$.confidence' AS DOUBLE) AS conf FROM sug),
cols AS (SELECT doc_id AS batch_id, 'doc_' || doc_id AS table_name, doc_id || '-' || k AS column_id, source || sfx AS column_name, dt, v FROM docs,
  (VALUES ('a', '_email', 'varchar', 'old'), ('b', '_date', 'DATE', 'old'), ('c', '_id', 'int', 'r, s')) t(k, sfx, dt, v))
SELECT c.batch_id, c.column_id, table_name, column_name, coalesce(st, 'unknown') AS semantic_type, CASE WHEN gt IS NULL THEN 'auto' ELSE lower(gt) END AS generator_type,
  CASE WHEN ends_with(c.column_id, '-a') THEN 'x, y' ELSE 'p, q' END AS allowed_values, coalesce(pii, 'false') = 'true' AS is_pii,
  least(greatest(coalesce(conf, 0.5), 0.0), 1.0) AS confidence, 'model' AS source FROM cols c JOIN given g USING (batch_id, column_id)
UNION ALL
SELECT c.batch_id, c.column_id, table_name, column_name, CASE right(c.column_id, 1) WHEN 'a' THEN 'email' WHEN 'b' THEN 'datetime' ELSE 'identifier' END,
  CASE right(c.column_id, 1) WHEN 'b' THEN 'datetime' ELSE 'categorical' END, v, right(c.column_id, 1) = 'a', 0.55, 'rules'
FROM cols c LEFT JOIN given g USING (batch_id, column_id) WHERE g.batch_id IS NULL"""


# --- links, settings and documents ---------------------------------------------------


def _raw_links(catalog):
    """Relation proposals from neighbouring words (``word_links``): some blank, unknown, reversed or repeated."""
    cols = catalog.where("position = 1")
    draw = R.below(4, "link", ["table_name", "column_name"], 6)
    return cols.select(
        F.concat(F.col("table_name"), F.lit(" ")).alias("from_table"), F.col("column_name").alias("from_column"),
        F.when(draw == 0, F.lit("")).when(draw == 1, F.col("table_name")).otherwise(F.regexp_replace("column_name", "_id$", "")).alias("to_table"),
        F.when(draw == 2, F.lit("missing")).otherwise(F.lit("id")).alias("to_column"),
        R.pick(["1:1", "n:n", "many", "1:N"], R.below(4, "card", ["table_name", "column_name"], 4)).alias("cardinality"),
        F.when(draw < 4, F.col("is_nullable")).alias("is_optional"),
        R.pick(["0.7", "1.5", "-1", "sure"], R.below(4, "conf", ["table_name", "column_name"], 4)).alias("confidence"),
        R.bits(4, "pos", ["table_name", "column_name"]).alias("position"),
    )


def link_validate(spark, d):
    catalog = word_links(spark, d)  # written once, read for both
    return C.validate_links(_raw_links(catalog), catalog)


_LP = ["table_name", "column_name"]
LINK_VALIDATE_SQL = f"""WITH {LINKS_SQL},
raw AS (SELECT table_name AS from_table, column_name AS from_column, CASE draw WHEN 0 THEN '' WHEN 1 THEN table_name ELSE regexp_replace(column_name, '_id$', '') END AS to_table,
  CASE draw WHEN 2 THEN 'missing' ELSE 'id' END AS to_column, upper({sql_pick(['1:1', 'n:n', 'many', '1:N'], sql_below(4, 'card', _LP, 4))}) AS card,
  CASE WHEN draw < 4 THEN is_nullable END AS opt, {sql_pick(['0.7', '1.5', '-1', 'sure'], sql_below(4, 'conf', _LP, 4))} AS conf
  FROM (SELECT *, {sql_below(4, 'link', _LP, 6)} AS draw FROM cols WHERE position = 1))
SELECT from_table, from_column, to_table, to_column, CASE WHEN card IN ('1:N', '1:1', 'N:1', 'N:N') THEN card ELSE '1:N' END AS cardinality,
 coalesce(opt, true) AS is_optional, least(greatest(coalesce(try_cast(conf AS DOUBLE), 0.6), 0.0), 1.0) AS confidence
FROM raw SEMI JOIN (SELECT DISTINCT table_name, column_name FROM cols) a ON a.table_name = from_table AND a.column_name = from_column
 SEMI JOIN (SELECT DISTINCT table_name, column_name FROM cols) b ON b.table_name = to_table AND b.column_name = to_column
WHERE to_table <> '' AND from_table <> to_table"""


def locked_columns(spark, d):
    return C.locked_columns(_raw_links(word_links(spark, d)).withColumn("from_table", F.trim("from_table")))


LOCKED_SQL = f"""WITH {LINKS_SQL}, raw AS (SELECT table_name, column_name, {sql_below(4, 'link', _LP, 6)} AS draw FROM cols WHERE position = 1)
SELECT table_name, column_name FROM raw UNION
SELECT CASE draw WHEN 1 THEN table_name ELSE regexp_replace(column_name, '_id$', '') END, CASE draw WHEN 2 THEN 'missing' ELSE 'id' END FROM raw WHERE draw <> 0"""


def row_edges(spark, d) -> tuple[DataFrame, DataFrame]:
    """Foreign keys between rows of the star schema and the turns of conversations, as (parent, child) edges."""

    def ref(table: str, c: str):
        return F.concat(F.lit(table + ":"), F.col(c).cast("string"))

    t = {n: load(spark, d, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "conversations")}
    turn = t["conversations"].select("conv_id", "turn")

    def at(k: int):
        return F.concat(F.lit("turn:"), F.col("conv_id"), F.lit("/"), F.col("turn") + k)

    edge = [
        t["nation"].select(ref("region", "n_regionkey").alias("parent"), ref("nation", "n_nationkey").alias("child"), F.lit("1:N").alias("cardinality")),
        t["customer"].select(ref("nation", "c_nationkey"), ref("customer", "c_custkey"), F.lit("1:N")),
        t["supplier"].select(ref("nation", "s_nationkey"), ref("supplier", "s_suppkey"), F.lit("1:1")),
        t["orders"].select(ref("customer", "o_custkey"), ref("orders", "o_orderkey"), F.lit("1:N")),
        t["lineitem"].select(ref("orders", "l_orderkey"), ref("part", "l_partkey"), F.lit("1:1")),
        t["lineitem"].select(ref("supplier", "l_suppkey"), ref("part", "l_partkey"), F.lit("1:N")),
        turn.where("turn > 0").select(at(-1), at(0), F.lit("1:1")),
    ]
    out = edge[0]
    for e in edge[1:]:
        out = out.union(e)
    nodes = t["region"].select(ref("region", "r_regionkey").alias("node")).union(t["part"].select(ref("part", "p_partkey")))
    return nodes, out


EDGES_SQL = """edges AS (
 SELECT 'region:' || n_regionkey AS parent, 'nation:' || n_nationkey AS child, 5 AS f FROM nation
 UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 5 FROM customer UNION SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 1 FROM supplier
 UNION SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey, 5 FROM orders UNION SELECT 'orders:' || l_orderkey, 'part:' || l_partkey, 1 FROM lineitem
 UNION SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 5 FROM lineitem
 UNION SELECT 'turn:' || conv_id || '/' || (turn - 1), 'turn:' || conv_id || '/' || turn, 1 FROM conversations WHERE turn > 0),
nodes AS (SELECT 'region:' || r_regionkey AS node FROM region UNION SELECT 'part:' || p_partkey FROM part UNION SELECT parent FROM edges UNION SELECT child FROM edges),
lv AS (SELECT node, 0 AS tier, 100::BIGINT AS rows FROM nodes WHERE node NOT IN (SELECT child FROM edges)
 UNION SELECT e.child, lv.tier + 1, lv.rows * e.f FROM lv JOIN edges e ON e.parent = lv.node)"""


def row_propagation(spark, d):
    return G.plan_rows(*row_edges(spark, d), base_rows=100)


def dag_tiers(spark, d):
    return G.tiers(*row_edges(spark, d)).groupBy("tier", F.substring_index("node", ":", 1).alias("table")).agg(F.count(F.lit(1)).alias("nodes"))


def graph_edges(spark, d):
    """Nodes with row counts and edges of the document-word catalog as one table."""
    cols = word_links(spark, d)
    tables = cols.groupBy("table_name").agg(F.count(F.lit(1)).alias("row_count"))
    rel = _raw_links(word_links(spark, d)).withColumn("from_table", F.trim("from_table")).where("to_table <> ''").withColumn("cardinality", F.upper("cardinality"))
    nodes, edges = C.graph_parts(tables, rel)
    a = nodes.select(F.lit("node").alias("part"), F.col("node").alias("name"), F.lit("").alias("other"), F.col("row_count").alias("size"), F.lit("").alias("detail"))
    b = edges.select(F.lit("edge"), "source", "target", F.lit(0).cast("bigint"), F.concat_ws("/", "from_column", "to_column", "cardinality", F.col("is_optional").cast("string")))
    return a.union(b)


GRAPH_SQL = f"""WITH {LINKS_SQL}, raw AS (SELECT table_name AS ft, column_name AS fc, CASE draw WHEN 1 THEN table_name ELSE regexp_replace(column_name, '_id$', '') END AS tt,
 CASE draw WHEN 2 THEN 'missing' ELSE 'id' END AS tc, upper({sql_pick(['1:1', 'n:n', 'many', '1:N'], sql_below(4, 'card', _LP, 4))}) AS card, CASE WHEN draw < 4 THEN is_nullable ELSE true END AS opt
 FROM (SELECT *, {sql_below(4, 'link', _LP, 6)} AS draw FROM cols WHERE position = 1) WHERE draw <> 0),
n AS (SELECT table_name AS node, count(*) AS c FROM cols GROUP BY 1)
SELECT 'node' AS part, node AS name, '' AS other, c AS size, '' AS detail FROM n
UNION ALL SELECT 'node', e, '', 0, '' FROM (SELECT ft AS e FROM raw UNION SELECT tt FROM raw) WHERE e NOT IN (SELECT node FROM n)
UNION ALL SELECT 'edge', ft, tt, 0, fc || '/' || tc || '/' || card || '/' || CAST(opt AS VARCHAR) FROM raw"""


def link_rows(spark, d):
    """Composite keys: every document references its source by two columns."""
    docs = load(spark, d, "documents", "doc_id")
    keys = docs.select(
        F.concat(F.lit("doc_"), "doc_id").alias("table_name"), F.array("lang", "source").alias("columns"), F.concat(F.lit("src_"), "source").alias("ref_table"),
        F.array(F.lit("lang"), F.lit("code")).alias("ref_columns"),
    )
    cols = docs.select(F.concat(F.lit("doc_"), "doc_id").alias("table_name"), F.col("lang").alias("column_name"), (F.col("n_chars") > 500).alias("is_nullable"))
    return C.link_rows(keys, cols)


LINK_ROWS_SQL = """SELECT 'doc_' || doc_id AS from_table, lang AS from_column, 'src_' || source AS to_table, 'lang' AS to_column, n_chars > 500 AS is_optional, '1:N' AS cardinality FROM documents
UNION ALL SELECT 'doc_' || doc_id, source, 'src_' || source, 'code', true, '1:N' FROM documents"""


def schema_specs(spark, d):
    """One schema payload per part, with a blank column that is dropped."""
    part = load(spark, d, "part")
    col = F.struct(
        F.concat(F.lit(" "), "p_name").alias("name"), R.pick(["", "int", "Decimal(8,2)", "timestamp", "varchar"], R.below(6, "t", "p_partkey", 5)).alias("data_type"),
        R.pick(["", "AUTO", "weird", "categorical"], R.below(6, "g", "p_partkey", 4)).alias("generator_type"),
        R.pick(["yes", "No", "1", ""], R.below(6, "m", "p_partkey", 4)).alias("mandatory"),
        F.concat("p_type", F.lit("; "), "p_brand", F.lit(",\n"), "p_type").alias("allowed_values"), (F.col("p_size") > 25).alias("expand_categories"),
    )
    blank = F.struct(
        F.lit(" ").alias("name"), F.lit("int").alias("data_type"), F.lit("").alias("generator_type"), F.lit("").alias("mandatory"),
        F.lit("").alias("allowed_values"), F.lit(False).alias("expand_categories"),
    )
    specs = part.select(F.col("p_partkey").alias("project_id"), F.array(F.struct(F.col("p_brand").alias("table_name"), F.array(col, blank).alias("columns"))).alias("tables"))
    return C.spec_rows(specs)


SPECS_SQL = f"""WITH t AS (SELECT *, {sql_pick(['', 'int', 'Decimal(8,2)', 'timestamp', 'varchar'], sql_below(6, 't', 'p_partkey', 5))} AS dt,
 {sql_pick(['', 'auto', 'weird', 'categorical'], sql_below(6, 'g', 'p_partkey', 4))} AS g, {sql_pick(['yes', 'no', '1', ''], sql_below(6, 'm', 'p_partkey', 4))} AS m FROM part)
SELECT p_partkey AS project_id, p_brand AS table_name, 1 AS position, trim(p_name) AS column_name, CASE WHEN dt = '' THEN 'varchar' ELSE dt END AS data_type,
 m NOT IN ('yes', '1') AS is_nullable, CASE WHEN g IN ('auto', 'categorical') THEN g WHEN dt = 'timestamp' THEN 'datetime' WHEN dt = 'int' THEN 'integer' WHEN dt LIKE 'Dec%' THEN 'numerical' ELSE 'categorical' END AS generator_type,
 p_type || ', ' || p_brand AS allowed_values, p_size > 25 AS expand_categories FROM t"""


def generation_settings(spark, d):
    """One setting per customer and table name; missing, negative and unreadable numbers."""
    cust = load(spark, d, "customer")
    tables = cust.select(F.col("c_name").alias("table_name"))
    settings = cust.where("c_acctbal > 0").select(
        F.col("c_name").alias("table_name"), R.pick(["12.9", "-3", "many", "none", "1e3"], R.below(8, "r", "c_custkey", 5)).alias("num_rows"),
        R.pick(["7", "-2.5", ""], R.below(8, "s", "c_custkey", 3)).alias("seed"),
    )
    return C.generation_settings(tables, settings)


SETTINGS_SQL = f"""SELECT c_name AS table_name, CASE WHEN c_acctbal > 0 THEN {sql_pick(['12', '1', '100', '100', '1000'], sql_below(8, 'r', 'c_custkey', 5))}::BIGINT ELSE 100 END AS num_rows,
CASE WHEN c_acctbal > 0 THEN {sql_pick(['7', '-2', '42'], sql_below(8, 's', 'c_custkey', 3))}::BIGINT ELSE 42 END AS seed FROM customer"""


def config_upsert(spark, d):
    """Column settings of every part, updated for the large parts."""
    part = load(spark, d, "part")
    cols = part.select(
        F.col("p_partkey").alias("column_id"), F.col("p_name").alias("column_name"), F.lit("text").alias("data_type"), F.lit("auto").alias("generator_type"),
        F.lit(0.0).alias("randomization_pct"), F.concat("p_type", F.lit(", "), "p_brand").alias("allowed_values"), F.lit("big, small").alias("allowed_values_expanded"),
        F.lit(False).alias("is_pii"), F.lit(True).alias("expand_categories"), F.lit(1.5).alias("null_value_percent"), F.lit("0").alias("min_val"), F.lit("9").alias("max_val"),
    )
    upd = part.where("p_size >= 25").select(
        F.col("p_partkey").alias("column_id"), F.when(F.col("p_size") > 40, F.lit("int")).alias("data_type"), F.lit("").alias("generator_type"),
        (F.col("p_size") * 1.0).alias("randomization_pct"), F.concat("p_type", F.lit(" ;"), F.when(F.col("p_size") > 30, F.col("p_brand")).otherwise(F.col("p_name"))).alias("allowed_values"),
        F.lit("one;two").alias("allowed_values_expanded"), F.lit(True).alias("is_pii"), F.lit(None).cast("boolean").alias("expand_categories"),
        F.lit("").alias("null_value_percent"), F.lit("5").alias("min_val"), F.lit("6").alias("max_val"),
        F.when(F.col("p_size") > 35, F.array(F.lit("min_val"), F.lit("null_value_percent"))).otherwise(F.array().cast("array<string>")).alias("stats"),
    )
    return C.upsert_config(cols, upd)


UPSERT_SQL = """SELECT p_partkey AS column_id, p_name AS column_name, CASE WHEN p_size < 25 THEN 'text' WHEN p_size > 40 THEN 'int' ELSE 'varchar' END AS data_type, 'auto' AS generator_type,
CASE WHEN p_size < 25 THEN 0.0 ELSE p_size END::DOUBLE AS randomization_pct, CASE WHEN p_size < 25 OR p_size > 30 THEN p_type || ', ' || p_brand ELSE p_type || ', ' || p_name END AS allowed_values,
CASE WHEN p_size < 25 THEN 'big, small' WHEN p_size > 30 THEN 'one, two' ELSE '' END AS allowed_values_expanded, p_size >= 25 AS is_pii, p_size < 25 AS expand_categories,
CASE WHEN p_size <= 35 THEN 1.5::DOUBLE END AS null_value_percent, CASE WHEN p_size > 35 THEN '5' ELSE '0' END AS min_val, '9' AS max_val FROM part"""


def _star_catalog(spark, d, dealt: bool = False) -> dict[str, DataFrame]:
    """Sources are projects, documents are tables, words are columns, labels are profiles, neighbours are links.

    ``dealt``: columns and profiles lie by table_id, which profiles have as well; those without one are left out.
    """
    docs = load(spark, d, "documents", "doc_id")
    named = docs.select("doc_id", "source", F.concat(F.lit("t"), F.col("n_chars").cast("string")).alias("table_name"), "lang", "n_chars")
    cols = words(spark, d, dealt).groupBy("doc_id", "word").agg(F.min("position").alias("position"))
    table = [F.col("doc_id").alias("table_id")] if dealt else []
    return {
        "projects": docs.select(F.col("source").alias("project_id"), F.lit("CSV").alias("source_type")).distinct(),
        "tables": named.select(F.col("source").alias("project_id"), F.col("doc_id").alias("table_id"), "table_name", F.col("n_chars").alias("row_count")),
        "columns": cols.select(F.col("doc_id").alias("table_id"), F.concat_ws("/", F.col("doc_id").cast("string"), "word").alias("column_id"), F.col("word").alias("column_name"), (F.col("position") + 1).alias("position"), F.lit("text").alias("data_type")),
        "column_profiles": cols.where("length(word) > 4").select(*table, F.concat_ws("/", F.col("doc_id").cast("string"), "word").alias("column_id"), F.length("word").alias("cardinality")),
        "relations": named.select(F.col("source").alias("project_id"), F.col("table_name").alias("from_table"), F.lit("id").alias("from_column"), F.concat(F.lit("t"), (F.col("n_chars") + 1).cast("string")).alias("to_table"), F.lit("id").alias("to_column")),
    }


STAR_SQL = f"""{WORDS_SQL}, tables AS (SELECT source AS project_id, doc_id AS table_id, 't' || n_chars AS table_name, n_chars AS row_count, lang FROM documents),
columns AS (SELECT doc_id AS table_id, doc_id || '/' || word AS column_id, word AS column_name, min(position) + 1 AS position, 'text' AS data_type FROM words GROUP BY doc_id, word),
profiles AS (SELECT column_id, length(column_name) AS cardinality FROM columns WHERE length(column_name) > 4),
relations AS (SELECT source AS project_id, 't' || n_chars AS from_table, 't' || (n_chars + 1) AS to_table FROM documents)"""


def project_columns(spark, d):
    c = _star_catalog(spark, d)
    return C.table_columns(c["tables"], c["columns"]).groupBy("project_id", "table_name").agg(F.count(F.lit(1)).alias("columns"), F.min("column_name").alias("first"))


PROJECT_COLUMNS_SQL = f"""WITH {STAR_SQL} SELECT project_id, table_name, count(*) AS columns, min(column_name) AS first FROM columns JOIN tables USING (table_id) GROUP BY ALL"""

_ASSOC = """concat('```json\n{"associations": [{"col_a": "', lang, '", "col_b": "', source, '", "association": "geography", "confidence": ', n_chars, '}, {"col_a": "x", "col_b": "', doc_id, '", "confidence": "low"}, {"col_a": "", "col_b": "z"}]}\n', '```')"""


def association_clean(spark, d):
    """Association replies, one per document."""
    docs = load(spark, d, "documents", "doc_id")
    return C.clean_associations(docs.select(F.col("doc_id").cast("string").alias("table_name"), F.expr(_ASSOC).alias("reply")))


ASSOCIATION_CLEAN_SQL = """SELECT CAST(doc_id AS VARCHAR) AS table_name, lang AS col_a, source AS col_b, 'geography' AS association, least(n_chars, 1)::DOUBLE AS confidence, 'inferred by model' AS reason FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'x', CAST(doc_id AS VARCHAR), 'other', 0.5, 'inferred by model' FROM documents"""


def schema_with_stats(spark, d):
    c = _star_catalog(spark, d)
    return C.columns_with_stats(c["columns"], c["column_profiles"]).groupBy("table_id").agg(
        F.count(F.lit(1)).alias("columns"), F.count("cardinality").alias("profiled"), F.sum("cardinality").alias("cardinality")
    )


SCHEMA_STATS_SQL = f"""WITH {STAR_SQL} SELECT table_id, count(*) AS columns, count(cardinality) AS profiled, CAST(sum(cardinality) AS BIGINT) AS cardinality
FROM columns LEFT JOIN profiles USING (column_id) GROUP BY table_id"""


def catalog_document(spark, d):
    c = _star_catalog(spark, d)
    docs = C.project_documents(c["tables"], c["columns"], page=1000)
    return docs.select("project_id", "table_id", "page", F.coalesce(F.size("columns"), F.lit(0)).alias("n"), F.md5(F.to_json(F.transform("columns", lambda x: x["column_name"]))).alias("digest"))


CATALOG_DOC_SQL = f"""WITH {STAR_SQL}, p AS (SELECT table_id, CAST((position - 1) // 1000 AS INTEGER) AS page, count(*) AS n,
 md5('["' || string_agg(column_name, '","' ORDER BY position) || '"]') AS digest FROM columns GROUP BY ALL)
SELECT project_id, t.table_id, coalesce(page, 0) AS page, coalesce(n, 0) AS n, digest FROM tables t LEFT JOIN p USING (table_id)"""


def _counts(c: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in c.items():
        keys = [k for k in ("project_id", "table_id", "column_id", "from_table", "to_table") if k in df.columns]
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("bigint")).alias("digest"))
        row = row.select(F.lit(name).alias("part"), "n", "digest")
        out = row if out is None else out.unionByName(row)
    return out


def _counts_sql(parts: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS part, count(*) AS n, CAST(sum(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM ({q})" for n, (q, key) in parts.items()
    )


def catalog_cascade_delete(spark, d):
    c = _star_catalog(spark, d)
    return _counts(C.delete_tables(c, c["tables"].where("row_count < 300").select("table_id")))


_LEFT = "SELECT * FROM tables WHERE row_count >= 300"
CASCADE_SQL = f"""WITH {STAR_SQL}, kept AS ({_LEFT}), kc AS (SELECT * FROM columns WHERE table_id IN (SELECT table_id FROM kept)),
gone AS (SELECT project_id, table_name FROM tables WHERE row_count < 300)
{_counts_sql({
    'projects': ("SELECT DISTINCT project_id FROM kept", "project_id"),
    'tables': ("SELECT * FROM kept", "project_id || '|' || table_id"),
    'columns': ("SELECT * FROM kc", "table_id || '|' || column_id"),
    'column_profiles': ("SELECT * FROM profiles WHERE column_id IN (SELECT column_id FROM kc)", "column_id"),
    'relations': ("SELECT * FROM relations r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.project_id = r.project_id AND g.table_name IN (r.from_table, r.to_table)) AND project_id IN (SELECT project_id FROM kept)", "project_id || '|' || from_table || '|' || to_table"),
})}"""


def project_delete(spark, d):
    c = _star_catalog(spark, d)
    doomed = c["tables"].groupBy("project_id").agg(F.max("row_count").alias("m")).where(F.expr("m % 2 = 0"))
    return _counts(C.delete_projects(c, doomed))


PROJECT_DELETE_SQL = f"""WITH {STAR_SQL}, doomed AS (SELECT project_id FROM tables GROUP BY 1 HAVING max(row_count) % 2 = 0),
kept AS (SELECT * FROM tables WHERE project_id NOT IN (SELECT project_id FROM doomed)), kc AS (SELECT * FROM columns WHERE table_id IN (SELECT table_id FROM kept))
{_counts_sql({
    'projects': ("SELECT DISTINCT project_id FROM kept", "project_id"),
    'tables': ("SELECT * FROM kept", "project_id || '|' || table_id"),
    'columns': ("SELECT * FROM kc", "table_id || '|' || column_id"),
    'column_profiles': ("SELECT * FROM profiles WHERE column_id IN (SELECT column_id FROM kc)", "column_id"),
    'relations': ("SELECT * FROM relations WHERE project_id NOT IN (SELECT project_id FROM doomed)", "project_id || '|' || from_table || '|' || to_table"),
})}"""


def relations_replace(spark, d):
    c = _star_catalog(spark, d)
    fresh = c["tables"].where("row_count > 4000").select("project_id", F.lit("fresh").alias("from_table"), F.lit("id").alias("from_column"), F.col("table_name").alias("to_table"), F.lit("id").alias("to_column"))
    return C.replace_links(c["relations"], fresh).select("project_id", "from_table", "to_table")


REPLACE_SQL = f"""WITH {STAR_SQL}, fresh AS (SELECT project_id, 'fresh' AS from_table, table_name AS to_table FROM tables WHERE row_count > 4000)
SELECT * FROM relations WHERE project_id NOT IN (SELECT project_id FROM fresh) UNION ALL SELECT * FROM fresh"""


def tables_dedupe(spark, d):
    """Documents and their second upload under a new id: exact copies collapse."""
    c = _star_catalog(spark, d)
    tables = c["tables"].select("table_id", F.lit("lake").alias("project_id"), F.lit("t").alias("table_name"), F.lit(0).alias("row_count"))
    return C.dedupe_tables(tables, c["columns"]).select("table_id", "n_columns", "copies")


DEDUPE_SQL = f"""WITH {STAR_SQL}, sig AS (SELECT table_id, count(*) AS n, string_agg(position || '|' || column_name, ',' ORDER BY position) AS s FROM columns GROUP BY table_id)
SELECT min(table_id) AS table_id, coalesce(n, 0) AS n_columns, count(*) AS copies FROM (SELECT table_id FROM tables) LEFT JOIN sig USING (table_id) GROUP BY n, s"""


def project_summary(spark, d):
    c = _star_catalog(spark, d)
    tables = c["tables"].withColumn("position", F.col("table_id"))
    cols = skew_join(c["columns"], tables.select("table_id", "project_id"), ["table_id"])
    return C.project_summaries(c["projects"], tables, cols, c["relations"].where("from_column = 'id'"))


SUMMARY_SQL = f"""WITH {STAR_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY table_id) AS k FROM tables),
a AS (SELECT project_id, count(*) AS nt, string_agg(table_name, ', ' ORDER BY k) FILTER (WHERE k <= 4) AS names FROM r GROUP BY 1),
b AS (SELECT project_id, count(*) AS nc FROM columns JOIN tables USING (table_id) GROUP BY 1), e AS (SELECT project_id, count(*) AS nr FROM relations GROUP BY 1)
SELECT project_id, nt AS table_count, nc AS column_count, nr AS relation_count,
nt || ' tables (' || names || CASE WHEN nt > 4 THEN ', ...' ELSE '' END || '), ' || nc || ' columns, ' || nr || ' relations; source=CSV. Typical relational synthetic-data project.' AS summary
FROM a JOIN b USING (project_id) JOIN e USING (project_id)"""


def table_digest(spark, d):
    cols = doc_columns(spark, d).withColumns({"is_pii": pii.name_signal("column_name")["score"] > 0.6, "min_val": F.col("column_name"), "max_val": F.lit(" ")})
    return C.table_digests(cols, 20, 6)


DIGEST_SQL = f"""WITH {DOC_COLUMNS_SQL}, r AS (SELECT *, lower(column_name) AS n, row_number() OVER (PARTITION BY table_name ORDER BY position) AS k FROM cols)
SELECT table_name, count(*) AS column_count, count_if(k <= 20 AND {_pii_name_case('{0}', 'score')} > 0.6) AS pii_column_count,
string_agg(column_name || ':' || data_type || ':' || CASE WHEN length(column_name) > 6 THEN substr(column_name, 1, 6) || '...' ELSE column_name END || ':', '; ' ORDER BY k) FILTER (WHERE k <= 20) AS columns_text
FROM r GROUP BY table_name"""

_ASK = ["what is the null rate of ", "minimum of ", "show MAX for ", "is this pii: ", "which relation uses ", "tell me about "]


def evidence_gaps(spark, d):
    """A question per word and document, answered from a catalog that knows only some fields."""
    cols = doc_columns(spark, d)
    asked = cols.select(
        F.concat_ws("/", "table_name", "column_name").alias("request_id"),
        F.concat(R.pick(_ASK, R.below(2, "ask", ["table_name", "column_name"], 6)), F.upper("table_name"), F.lit("."), "column_name", F.lit("?")).alias("message"),
    )
    n = F.length("column_name")
    known = cols.where(n > 4).select(
        "table_name", "column_name", "position", F.when(n > 6, n * 1.0).alias("null_percent"), F.when(n > 8, F.lit("a")).otherwise("").alias("min"),
        F.col("column_name").alias("max"), F.when(n > 7, F.lit(True)).alias("is_pii"),
    )
    rel = cols.where(n > 9).select(F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"), F.lit("").alias("to_table"), F.lit("").alias("to_column"))
    return C.missing_evidence(asked, known, rel)


EVIDENCE_GAPS_SQL = f"""WITH {DOC_COLUMNS_SQL}, q AS (SELECT *, {sql_below(2, 'ask', ['table_name', 'column_name'], 6)} AS a, length(column_name) AS n FROM cols),
f AS (SELECT table_name || '/' || column_name AS request_id, lower(['what is the null rate of ', 'minimum of ', 'show max for ', 'is this pii: ', 'which relation uses ', 'tell me about '][a + 1] || table_name || '.' || column_name) AS m, n FROM q),
g AS (SELECT *, CASE WHEN contains(m, 'null') THEN 'null_percent' WHEN contains(m, 'min') THEN 'min' WHEN contains(m, 'max') THEN 'max' WHEN contains(m, 'pii') THEN 'is_pii'
  WHEN regexp_matches(m, 'relationship|relation|foreign key|fk') THEN 'relationship' END AS field FROM f)
SELECT request_id, field AS requested, CASE field WHEN 'null_percent' THEN CASE WHEN n > 6 THEN NULL ELSE field END WHEN 'min' THEN CASE WHEN n > 8 THEN NULL ELSE field END
 WHEN 'max' THEN CASE WHEN n > 4 THEN NULL ELSE field END WHEN 'is_pii' THEN CASE WHEN n > 7 THEN NULL ELSE field END WHEN 'relationship' THEN CASE WHEN n > 9 THEN NULL ELSE field END END AS missing FROM g"""


def value_lists(spark, d):
    """List handling on the documents' own lines: values, weights, clipping, squeezing."""
    docs = load(spark, d, "documents", "doc_id")
    w = X.weighted_values(F.concat(F.col("lang"), F.lit("|"), F.col("n_chars").cast("string"), F.lit("; "), F.col("source"), F.lit(",\n"), F.col("lang"), F.lit("|9")))
    return docs.select(
        "doc_id", F.size(X.value_array("text")).alias("n_values"), F.md5(X.value_list("text")).alias("values_digest"),
        F.array_join(F.transform(w, lambda e: F.concat(e["value"], F.lit("="), F.round(e["weight"] * 1e6).cast("bigint").cast("string"))), ";").alias("weights"),
        F.md5(X.squash("text", 280)).alias("squashed"), X.clip("text", 30).alias("clipped"),
        F.array_join(X.list_like(F.concat("source", F.lit(" , ,"), "lang")), "|").alias("listed"),
        X.resolve_values(F.col("n_chars") > 900, F.col("source"), F.when(F.col("lang") == "en", F.lit("e; f"))).alias("resolved"),
    )


_STRIP = "trim({0}, e' \\t\\n\\r\\x0b\\x0c')"
VALUE_LISTS_SQL = f"""WITH v AS (SELECT doc_id, {_STRIP.format('s')} AS s, i FROM (SELECT doc_id, unnest(string_split_regex(text, '[\\n,;]+')) AS s, generate_subscripts(string_split_regex(text, '[\\n,;]+'), 1) AS i FROM documents)),
u AS (SELECT doc_id, s, min(i) AS i FROM v WHERE s <> '' GROUP BY ALL),
g AS (SELECT doc_id, count(*) AS n_values, md5(string_agg(s, ', ' ORDER BY i)) AS values_digest FROM u GROUP BY doc_id),
x AS (SELECT *, {_STRIP.format("regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')")} AS sq, {_STRIP.format('text')} AS st FROM documents)
SELECT x.doc_id, coalesce(n_values, 0) AS n_values, coalesce(values_digest, md5('')) AS values_digest,
lang || '=' || CAST(CAST(round(n_chars::DOUBLE / (n_chars + 1) * 1e6) AS BIGINT) AS VARCHAR) || ';' || source || '=' || CAST(CAST(round(1.0::DOUBLE / (n_chars + 1) * 1e6) AS BIGINT) AS VARCHAR) AS weights,
md5(CASE WHEN length(sq) > 280 THEN rtrim(substr(sq, 1, 277)) || '...' ELSE sq END) AS squashed,
CASE WHEN st = '' THEN NULL WHEN length(st) <= 30 THEN st ELSE substr(st, 1, 30) || '...' END AS clipped, source || '|' || lang AS listed,
CASE WHEN n_chars > 900 AND lang = 'en' THEN 'e, f' ELSE source END AS resolved FROM x LEFT JOIN g USING (doc_id)"""


def name_forms(spark, d):
    """Every different word in its normal forms."""
    w = F.col("column_name")
    return column_names(spark, d).select("column_name", X.snake(w).alias("snake"), X.tokens_name(w).alias("tokens"), X.tight(w).alias("tight"), X.singular(X.tight(w)).alias("singular"), F.lit(X.quote("a`b")).alias("quoted"))


NAME_FORMS_SQL = f"""{NAMES_SQL} SELECT column_name, trim(regexp_replace(lower(column_name), '[^a-z0-9_]+', '_', 'g'), '_') AS snake,
trim(regexp_replace(lower(column_name), '[^a-z0-9]+', '_', 'g'), '_') AS tokens, t AS tight, {_singular_sql('t')} AS singular, '`a``b`' AS quoted
FROM (SELECT *, {TIGHT.format('column_name')} AS t FROM names)"""

QUERIES = {
    "pii_names": pii_names, "semantic_types": semantic_types, "pk_pick": pk_pick, "fk_by_name": fk_by_name, "associations": associations,
    "category_expand": category_expand, "pii_token_hits": pii_token_hits, "pii_columns": pii_columns, "pii_entities": pii_entities,
    "expansion_clean": expansion_clean, "suggestion_clean": suggestion_clean, "link_validate": link_validate, "locked_columns": locked_columns, "dag_tiers": dag_tiers,
    "row_propagation": row_propagation, "graph_edges": graph_edges, "link_rows": link_rows, "schema_specs": schema_specs,
    "generation_settings": generation_settings, "config_upsert": config_upsert, "schema_with_stats": schema_with_stats,
    "catalog_document": catalog_document, "catalog_cascade_delete": catalog_cascade_delete, "project_delete": project_delete,
    "relations_replace": relations_replace, "tables_dedupe": tables_dedupe, "project_summary": project_summary, "table_digest": table_digest,
    "evidence_gaps": evidence_gaps, "value_lists": value_lists, "name_forms": name_forms, "project_columns": project_columns, "association_clean": association_clean,
}

ORACLES = {
    "pii_names": PII_NAMES_SQL, "semantic_types": SEMANTIC_SQL,
    "pk_pick": f"WITH {LINKS_SQL}, {PKS_SQL} SELECT table_name, pk_column FROM pks",
    "fk_by_name": FK_BY_NAME_SQL, "associations": ASSOCIATIONS_SQL, "category_expand": CATEGORY_SQL, "pii_token_hits": PII_TOKENS_SQL,
    "pii_columns": _pii_columns_sql(), "expansion_clean": EXPANSION_SQL, "suggestion_clean": SUGGESTION_SQL, "link_validate": LINK_VALIDATE_SQL, "locked_columns": LOCKED_SQL,
    "dag_tiers": f"WITH RECURSIVE {EDGES_SQL}, m AS (SELECT node, max(tier) AS tier FROM lv GROUP BY node) SELECT tier, split_part(node, ':', 1) AS \"table\", count(*) AS nodes FROM m GROUP BY ALL",
    "row_propagation": f"WITH RECURSIVE {EDGES_SQL} SELECT node, max(tier) AS tier, max(rows) AS rows FROM lv GROUP BY node",
    "graph_edges": GRAPH_SQL, "link_rows": LINK_ROWS_SQL, "schema_specs": SPECS_SQL, "generation_settings": SETTINGS_SQL, "config_upsert": UPSERT_SQL,
    "schema_with_stats": SCHEMA_STATS_SQL, "catalog_document": CATALOG_DOC_SQL, "catalog_cascade_delete": CASCADE_SQL, "project_delete": PROJECT_DELETE_SQL,
    "relations_replace": REPLACE_SQL, "tables_dedupe": DEDUPE_SQL, "project_summary": SUMMARY_SQL, "table_digest": DIGEST_SQL,
    "project_columns": PROJECT_COLUMNS_SQL, "association_clean": ASSOCIATION_CLEAN_SQL,
    "evidence_gaps": EVIDENCE_GAPS_SQL, "value_lists": VALUE_LISTS_SQL, "name_forms": NAME_FORMS_SQL,
}
