"""Secret scans: sure spans by pattern, and parts of credentials that count only where complementary parts meet.

Only DataFrame functions run here. Texts turn into rows of parts (kind, start, end in code points); an interval join
within scopes then decides which weak parts are reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.common import packed, staged, table, unpacked


@dataclass(frozen=True)
class Kind:
    """pattern: matched leftmost, non-overlapping; `measured` group must have `least` code points.

    role: what part of a credential it is; weak: reported only beside a complementary part.
    """

    name: str
    pattern: str
    role: str
    measured: int = 0
    least: int = 1
    weak: bool = False


#: The patterns of the sure kinds, in the order in which equal starts are listed.
BASE = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", "access"),
    Kind("hex", r"[0-9a-f]{24,}", "secret"),
)
#: Parts that say little alone.
WEAK = (
    Kind("user", r"""(?i)(?:user(?:name|_?id)?|login|account|client_?id|access_?key_?id)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9_.@-]+)""", "access", 1, 3, weak=True),
    Kind("opaque", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_-])", "secret", weak=True),
    Kind("endpoint", r"""(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+""", "endpoint", weak=True),
)
SCOPE = 200  # code points between complementary parts, at most


def _lengths(text: Column, kind: Kind) -> Column:
    """For each match: code points before it (since the match before), in it, and in its measured group."""
    before = F.transform(F.split(text, kind.pattern, -1), F.char_length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.char_length)
    measured = F.transform(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.measured)), F.char_length) if kind.measured else whole
    made = F.zip_with(F.zip_with(whole, measured, lambda w, m: F.struct(w.alias("w"), m.alias("m"))), F.slice(before, F.lit(1), F.size(whole)), lambda x, b: F.struct(b.alias("b"), x["w"].alias("w"), x["m"].alias("m")))
    return F.when(text.rlike(kind.pattern), made)


def parts(docs: DataFrame, key: list[str], text: str = "text", kinds: tuple[Kind, ...] = BASE + WEAK) -> DataFrame:
    """A row for each part found: key columns, kind (number), start, end; starts are running sums over a text's matches."""
    source = F.coalesce(F.col(text), F.lit(""))
    found = F.array(*[F.struct(F.lit(i).alias("kind"), _lengths(source, kind).alias("found")) for i, kind in enumerate(kinds)])
    rows = docs.select(*key, F.explode(F.filter(found, lambda x: x["found"].isNotNull())).alias("k"))
    rows = rows.select(*key, "k.kind", F.posexplode("k.found").alias("place", "x")).distinct()
    so_far = Window.partitionBy(*key, "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("x.b") + F.col("x.w")).over(so_far))
    least = F.element_at(F.array(*[F.lit(k.least) for k in kinds]), F.col("kind") + 1)
    return rows.where(F.col("x.m") >= least).select(*key, "kind", (F.col("end") - F.col("x.w")).alias("start"), "end")


def linked(found: DataFrame, key: list[str], kinds: tuple[Kind, ...] = BASE + WEAK, scope: int = SCOPE) -> DataFrame:
    """The sure parts, and of the weak ones those with a complementary part at most `scope` code points away.

    A secret completes an access identifier or an endpoint and the other way round. The interval join meets parts in
    buckets of the text one scope wide, so that no text is compared with itself as a whole; a left semi join, so a part
    comes out once however many partners it has.
    """
    attribute = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("kind") + 1)
    found = found.withColumn("secret", attribute([k.role == "secret" for k in kinds])).withColumn("weak", attribute([k.weak for k in kinds]))
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))
    left = found.where("weak").withColumn("cell", cells(F.col("start") - scope, F.col("end") + scope))
    right = found.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("secret").alias("_secret"), F.col("start").alias("_start"), F.col("end").alias("_end"), cells(F.col("start"), F.col("end")).alias("_cell"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    meets = (F.col("cell") == F.col("_cell")) & (F.col("secret") != F.col("_secret")) & (F.col("_start") <= F.col("end") + scope) & (F.col("_end") >= F.col("start") - scope)
    for s in same:
        meets = meets & s
    weak = left.join(right, meets, "left_semi").drop("cell").distinct()
    return found.where("NOT weak").unionByName(weak).select(*key, "kind", "start", "end")


def spans(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = BASE + WEAK, scope: int = SCOPE) -> DataFrame:
    """doc_id, text_key and `spans`, sorted (start, kind, end), of every document that has any."""
    key = ["doc_id", "text_key"]
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.col(text).alias("_text"))
    found = linked(staged(parts(keyed, key, "_text", kinds), "parts"), key, kinds, scope)
    return found.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))


def redacted(docs: DataFrame, found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every reported span replaced by `mark` (overlapping spans by one); n_chars follows."""
    names = ["doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else [])]
    found = found.select(
        F.col("doc_id").alias("_doc"),
        F.col("text_key").alias("_key"),
        F.aggregate(
            "spans",
            F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)"),
            lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] > x["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["end"]).alias("e"))))).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("s"), x["end"].alias("e"))))),
        ).alias("_cut"),
    )
    keyed = packed(docs, names).withColumn("_text_key", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    joined = keyed.join(found, keyed["doc_id"].eqNullSafe(F.col("_doc")) & (F.col("_text_key") == F.col("_key")), "left")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("_cut", lambda c: c["e"]))
    ends = F.concat(F.transform("_cut", lambda c: c["s"]), F.array(F.char_length("text").cast("long")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.col("text").substr((a + 1).cast("int"), (b - a).cast("int")))
    text = F.when(F.col("_cut").isNotNull(), F.array_join(pieces, mark)).otherwise(F.col("text"))
    joined = joined.withColumn("text", text)
    if "n_chars" in names:
        joined = joined.withColumn("n_chars", F.when(F.col("_cut").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return unpacked(joined, docs.columns, names)


def op6_linked_credentials(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document, as counts, a digest of the sure spans and all spans.

    Null text counts as empty. Documents without spans have zero counts, the digest of no bytes and an empty `spans`.
    Rows that repeat a doc_id are told apart by their text; equal rows get equal answers. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = spans(docs).withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    ids = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text_key"))
    joined = ids.join(found, ids["doc_id"].eqNullSafe(F.col("_doc")) & (F.col("_text_key") == F.col("_key")), "left")
    names = F.array(*[F.lit(k.name) for k in BASE + WEAK])
    listed = lambda column: F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    every = F.coalesce(F.col("spans"), F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"))
    base = F.filter(every, lambda x: x["kind"] < len(BASE))
    count = lambda i: F.size(F.filter(every, lambda x: x["kind"] == i)).cast("long")
    return joined.select("doc_id", *[count(i).alias(f"n_{k.name}") for i, k in enumerate(BASE)], F.sha2(listed(base), 256).alias("base_sha256"), listed(every).alias("spans"))


def _sql_places(name: str, pattern: str, group: int, least: int) -> str:
    """Matches of a pattern in DuckDB: kind, start, end of those whose group has `least` code points."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, text, '{name}' AS kind, start, start + w AS "end" FROM (
      SELECT doc_id, text, w, m, sum(b + w) OVER (PARTITION BY doc_id ORDER BY i) - w AS start FROM (
        SELECT doc_id, text, unnest(range(len(f))) AS i, unnest(list_transform(f, lambda x: length(x))) AS w, unnest(list_transform(g, lambda x: length(x))) AS m, unnest(list_transform(s[1 : len(f)], lambda x: length(x))) AS b FROM (
          SELECT doc_id, text, regexp_extract_all(text, '{quoted}') AS f, regexp_extract_all(text, '{quoted}', {group}) AS g, string_split_regex(text, '{quoted}') AS s FROM t))) WHERE m >= {least}"""


#: RE2 has neither possessive nor looking patterns: those of WEAK say the same by plain ones and by what follows a run.
#: It takes the long s (383) and the Kelvin sign (8490) for letters in either case; the patterns here do not.
_TOKEN = "[A-Za-z0-9+/_-]"
OP6_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), chr(383) || chr(8490), '??') AS text FROM documents),
base AS ({" UNION ALL ".join(_sql_places(k.name, k.pattern, k.measured, k.least) for k in BASE)}),
runs AS ({_sql_places("opaque", _TOKEN + "{32,}", 0, 1)}),
tails AS (SELECT *, substr(text, start::BIGINT + 1, ("end" - start)::BIGINT) AS run, length(regexp_extract(substr(text, "end"::BIGINT + 1, 3), '^=*')) AS marks, regexp_matches(substr(text, "end"::BIGINT + 1, 3), '^={{1,2}}{_TOKEN}') AS goes_on FROM runs),
opaque AS (SELECT doc_id, text, kind, start, "end" + CASE WHEN goes_on THEN marks - 1 ELSE least(marks, 2) END AS "end" FROM tails WHERE regexp_matches(run, '[0-9]') AND regexp_matches(run, '[A-Za-z]')),
users AS ({_sql_places(WEAK[0].name, WEAK[0].pattern.replace("*+", "*"), WEAK[0].measured, WEAK[0].least)}),
ends AS ({_sql_places(WEAK[2].name, WEAK[2].pattern.replace(chr(92) + "s", chr(92) + "x20" + chr(92) + "x09-" + chr(92) + "x0D"), 0, 1)}),
parts AS (SELECT doc_id, start::BIGINT AS start, "end"::BIGINT AS "end", kind, list_position(['assign', 'access', 'hex', 'user', 'opaque', 'endpoint'], kind) AS k, kind IN ('assign', 'hex', 'opaque') AS secret
          FROM (SELECT * FROM base UNION ALL SELECT * FROM users UNION ALL SELECT * FROM opaque UNION ALL SELECT * FROM ends)),
found AS (SELECT doc_id, start, "end", kind, k FROM parts WHERE k <= 3 UNION ALL
          SELECT doc_id, start, "end", kind, k FROM parts a WHERE k > 3 AND EXISTS (SELECT 1 FROM parts b WHERE b.doc_id = a.doc_id AND b.secret <> a.secret AND b.start <= a."end" + {SCOPE} AND b."end" >= a.start - {SCOPE})),
told AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, k, "end") AS spans, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, k, "end") FILTER (k <= 3) AS base,
         count(*) FILTER (k = 1) AS n_assign, count(*) FILTER (k = 2) AS n_access, count(*) FILTER (k = 3) AS n_hex FROM found GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN told USING (doc_id)
"""
