"""One query for each operator, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, dialogue, langid, line_dedup, lm_score, mixing, near_dedup, simhash, substring_dedup, token_output, url_filter, whitening
from .common import read, remainder
from .registry import REGISTRY, query

__all__ = ["REGISTRY"]

# --- 1: language-model scores ------------------------------------------------


@query()
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return lm_score.score_texts(docs, F.coalesce(remainder(F.col("doc_id"), 7) != 2, F.lit(True)))


# --- 2: nearest neighbours ---------------------------------------------------


@query()
def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


# --- 3: token ids ------------------------------------------------------------

TOKENIZER, END_ID = "word_bpe_49k.json", 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_output.write_tokens(read(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return token_output.read_tokens(manifest)


# --- 4: repeated passages ----------------------------------------------------


@query()
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


# --- 5: near duplicates ------------------------------------------------------


@query()
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


# --- 6: mixing ---------------------------------------------------------------

MIX_POWER, MIX_SEED = 0.5, "mix"


@query(f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, CAST(pow(CAST(n AS DOUBLE), {MIX_POWER}) AS DECIMAL(38,6)) AS weight FROM n),
r AS (SELECT source, CAST(1 AS DOUBLE) * (CAST(weight AS DOUBLE) / (SELECT CAST(sum(weight) AS DOUBLE) FROM w))
             * CAST((SELECT sum(n) FROM w) AS BIGINT) / n AS rate FROM w),
terms AS (SELECT source, rate, unnest(generate_series(0, 63)) AS k FROM r),
cdf AS (SELECT source, k, sum(exp(-rate) * pow(rate, k) / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS below FROM terms),
u AS (SELECT doc_id, source, CAST(('0x' || substr(md5('{MIX_SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|1'), 1, 13)) AS BIGINT)
             / 4503599627370496.0 AS u FROM documents),
counted AS (SELECT u.doc_id, u.source, CAST(count(cdf.k) AS INTEGER) AS copies
            FROM u LEFT JOIN cdf ON cdf.source IS NOT DISTINCT FROM u.source AND cdf.below <= u.u GROUP BY u.doc_id, u.source)
SELECT doc_id, source, copies, CAST(unnest(generate_series(0, copies - 1)) AS INTEGER) AS copy_no FROM counted WHERE copies > 0""")
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.rates(docs, power=MIX_POWER), MIX_SEED)
    return mixed.select("doc_id", "source", "copies", "copy_no")


# --- 7: decontamination ------------------------------------------------------


@query()
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


# --- 8: language -------------------------------------------------------------


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    prototypes = langid.learn(docs.filter(~held_out))
    said = langid.identify(docs.select("doc_id", "text"), prototypes)
    return said.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


# --- 9: URL filters ----------------------------------------------------------

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

_CANONICAL = "CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') END"
_RULE = "CASE " + " ".join(
    f"WHEN (host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '/{p}') THEN '{rule}'"
    for rule in sorted(RULES, key=lambda r: (-len(r), r))
    for d, _, p in [rule.partition("/")]
) + " END"


@query(f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT page_id, host, path, {_RULE} AS rule, {_CANONICAL} AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM ruled WHERE md5(canonical) LIKE '0%')
SELECT page_id, host, path, rule,
       CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES.items())} WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""")
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: the canonical URLs of the pages whose md5 begins with 0, as no table of bad URLs is given."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.select(url_filter.canonical(*url_filter.host_and_path(F.col("url"))).alias("canonical"))
    listed = listed.filter(F.md5(F.col("canonical").cast("binary")).startswith("0"))
    return url_filter.judge(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")


# --- 10: line dedup ----------------------------------------------------------

MIN_SITES = 10


@query(f"""
WITH split AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
rows AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM split),
keyed AS (SELECT *, nullif(regexp_replace(line, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g'), '') AS bare FROM rows),
spread AS (SELECT bare FROM keyed WHERE bare IS NOT NULL GROUP BY bare HAVING count(DISTINCT source) >= {MIN_SITES}),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bare IN (SELECT bare FROM spread)) AS n_removed,
                string_agg(line, chr(10) ORDER BY place) FILTER (WHERE bare IS NULL OR bare NOT IN (SELECT bare FROM spread)) AS kept
         FROM keyed GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents AS d LEFT JOIN kept USING (doc_id)""")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = line_dedup.remove_lines(docs, MIN_SITES, site="source")
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


# --- 11: whitening -----------------------------------------------------------

COMPONENTS = 16


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors, components=COMPONENTS)
    white = whitening.whiten(vectors, model)
    n, error, explained = (model.n, model.identity_error, model.explained) if model else (0, 0.0, [])
    shares = F.array(*map(F.lit, explained)) if explained else F.array().cast("array<double>")
    rows = white.select("vec_id", F.posexplode("whitened").alias("place", "whitened"), "deviation")
    return rows.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


# --- 12: conversations -------------------------------------------------------


def _dearer(state: str, cost: int | str, edit: str) -> str:
    """A state of the SQL, nine digits of cost and the audit, after one more edit; the least of such strings is the cheapest."""
    return f"lpad(CAST(CAST(substr({state}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{edit}'"


def _after(state: str, *others: str) -> str:
    """After a row's edits: deletion, or what else leads to ``state`` from ``others`` where it is allowed."""
    rest = [f"CASE WHEN code <> 'x' THEN {_dearer(o, '3 + more', 'R')} END" for o in others if state in "ua"]
    kept = [f"CASE WHEN code = '{state}' THEN {_dearer(o, 'more', 'K')} END" for o in others]
    return "least(" + ", ".join([_dearer(f"of_{state}", 4, "D"), *kept, *rest]) + ")"


_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END))"""
_GAP = "\\x20\\x09-\\x0D"


@query(f"""
WITH RECURSIVE asked AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({_CRC}, CAST(4294967295 AS BIGINT)) % 20 AS kind FROM asked),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds WHERE kind <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place FROM damaged),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{_GAP}]') THEN 'blank'
                          WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
                          WHEN NOT regexp_matches(text, '[.!?][{_GAP}]*$') THEN 'truncated' ELSE '' END AS fault,
                  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY place) || substr(role, 1, 1) AS pair FROM ordered),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
                   count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                   count(*) FILTER (WHERE fault = 'truncated') AS truncated,
                   count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
run AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS place, '000000000' AS of_0, CAST(NULL AS VARCHAR) AS of_s, '000000003I' AS of_u, '000000006II' AS of_a FROM counted
  UNION ALL
  SELECT conv_id, place, to_0, to_s, least(to_u, {_dearer("to_0", 3, "I")}, {_dearer("to_s", 3, "I")}, {_dearer("to_a", 3, "I")}),
         least(to_a, {_dearer("to_u", 3, "I")}, {_dearer("to_0", 6, "II")}, {_dearer("to_s", 6, "II")})
  FROM (SELECT conv_id, place, {_dearer("of_0", 4, "D")} AS to_0, {_after("s", "of_0")} AS to_s,
               {_after("u", "of_0", "of_s", "of_a")} AS to_u, {_after("a", "of_u")} AS to_a
        FROM (SELECT f.conv_id, f.place, of_0, of_s, of_u, of_a, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' ELSE substr(role, 1, 1) END AS code,
                     CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more
              FROM run AS r JOIN faults AS f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.place = r.place + 1))),
best AS (SELECT c.conv_id, least(of_0, of_a) AS best FROM run AS r JOIN counted AS c ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.n = r.place),
edits AS (SELECT conv_id, unnest(string_split(substr(best, 10), '')) AS edit, generate_subscripts(string_split(substr(best, 10), ''), 1) AS i FROM best WHERE length(best) > 9),
placed AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS place FROM edits),
turns AS (SELECT p.conv_id, i, edit, f.role, f.text, row_number() OVER (PARTITION BY p.conv_id ORDER BY i) AS m,
                 first_value(edit = 'K' AND substr(f.role, 1, 1) = 's') OVER (PARTITION BY p.conv_id ORDER BY i) AS led
          FROM placed AS p LEFT JOIN faults AS f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.place = p.place AND p.edit <> 'I' WHERE edit <> 'D'),
repaired AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - CAST(led AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                        || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS lines FROM turns GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(CAST(substr(best, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(best, 10), '') AS audit,
       sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN counted AS c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best AS b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN repaired AS r ON r.conv_id IS NOT DISTINCT FROM a.conv_id""")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged, present = dialogue.damage(read(spark, sf_dir, "conversations"))
    out = dialogue.repair(damaged, present=present)
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    digest = F.sha2(F.array_join(lines, "\n").cast("binary"), 256)
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", digest.alias("repaired_sha256"))


# --- 13: fingerprints --------------------------------------------------------


@query()
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare_edited(read(spark, sf_dir, "documents").select("doc_id", "text"))
