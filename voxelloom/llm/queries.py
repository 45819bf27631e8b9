"""The text operators as queries over whole tables, and in SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm import (
    decontamination,
    filter_audit,
    fingerprints,
    licenses,
    lines,
    near_duplicates,
    packing,
    quality,
    substrings,
    token_counts,
    toxicity,
    url_filter,
    vector_codes,
)
from voxelloom.llm.common import FEW_KEYS, LOWER, UPPER, WORD, keyed, scratch_folder, stored, table


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token totals of all documents after a load, its repetition, and the revision, deletion and return of exact copies."""
    docs = table(spark, folder, "documents")
    store = token_counts.CountStore(spark, scratch_folder(spark, "counts"), docs.schema["doc_id"].dataType)
    store.upsert("load", docs)
    store.upsert("load", docs)
    copies = stored(token_counts.exact_copies(docs).distinct())
    few = F.broadcast(copies) if copies.count() <= FEW_KEYS else copies
    changing = docs.join(few, docs["doc_id"].eqNullSafe(few["doc"]), "left_semi")
    store.upsert("revised", changing.withColumn("text", F.concat("text", F.lit(" revised"))))
    store.delete("copies", copies)
    store.upsert("returned", changing)
    return store.totals()


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Expected severity of every document."""
    docs = keyed(table(spark, folder, "documents"), "doc_id", "text")
    return toxicity.severity(docs, table(spark, folder, "labels")).drop("text")


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document that stand in a passage of ten words of the benchmark."""
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def _sql_words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{WORD}')"


OP4_SQL = f"""
WITH docs AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
items AS (SELECT item_id, {_sql_words("text")} AS w FROM benchmark),
phrases AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[pos + 1 : pos + 10], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, least(len(w), 1)))) AS pos FROM items)
), places AS (
    SELECT doc_id, size, pos, array_to_string(w[pos + 1 : pos + size], ' ') AS phrase
    FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS pos FROM docs, (SELECT DISTINCT size FROM phrases))
), found AS (
    SELECT doc_id, size, pos, item_id FROM places JOIN phrases USING (size, phrase)
), hits AS (
    SELECT doc_id, count(DISTINCT pos + i) AS n_hit FROM (SELECT doc_id, pos, unnest(range(size)) AS i FROM found) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of at least 50 words that documents share."""
    return substrings.repeats(table(spark, folder, "documents"))


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return fingerprints.edited_pairs(table(spark, folder, "documents"))


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The class of near duplicates of every document."""
    return near_duplicates.classes(table(spark, folder, "documents"))


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document; a third of the labelled rows is never learned from."""
    docs = keyed(table(spark, folder, "documents"), "doc_id", "text")
    return quality.assess(docs, table(spark, folder, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that repeat across documents, dropped from all but the largest document."""
    done = lines.dedup_lines(keyed(table(spark, folder, "documents"), "doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = f"""
WITH lines AS (
    SELECT doc_id, place, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place FROM documents)
), repeated AS (
    SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT l.*, coalesce(l.doc_id <> r.last_doc, false) AS gone FROM lines l LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return licenses.scan(table(spark, folder, "documents")).drop("matches")


def _op10_sql() -> str:
    known = {label: licenses.words(text) for label, text in licenses.TEMPLATES}
    rows = ", ".join(f"('{label}', '{w.decode()}', {len(own)}, {len(set(own))})" for label, own in known.items() for w in sorted(set(own)))
    phrases = ", ".join(f"('{label}', '{text}', {len(text.split())})" for text, label in licenses.PHRASES.items())
    return f"""
WITH docs AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM docs),
templates AS (SELECT * FROM (VALUES {rows}) AS t(label, word, step, n)),
phrases AS (SELECT * FROM (VALUES {phrases}) AS t(label, phrase, n)),
base AS (
    SELECT d.doc_id, p.label, pos FROM placed JOIN docs d USING (doc_id) JOIN phrases p
    ON split_part(p.phrase, ' ', 1) = placed.word AND array_to_string(w[pos + 1 : pos + p.n], ' ') = p.phrase
), blocks AS (
    SELECT doc_id, label, block, count(DISTINCT word) / any_value(n) AS score
    FROM (SELECT doc_id, label, word, n, unnest([pos // step, pos // step - 1]) AS block FROM placed JOIN templates USING (word))
    WHERE block >= 0 GROUP BY doc_id, label, block HAVING count(DISTINCT word) >= ceil(round({licenses.THRESHOLD} * any_value(n), 9))
), counted AS (
    SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
    FROM base GROUP BY doc_id
), named AS (
    SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM blocks) GROUP BY doc_id
), best AS (SELECT doc_id, max(score) AS score FROM blocks GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
"""


def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A verdict on the url of every page."""
    return url_filter.judge(table(spark, folder, "pages"), table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters does at each place of every order, per source."""
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP12_SQL = """
WITH docs AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT t, min(doc_id) AS m FROM docs GROUP BY t),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
judged AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
           concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
                  CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END,
                  CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN d.doc_id > m THEN 'E' ELSE '' END) AS fails
    FROM docs d JOIN firsts USING (t) LEFT JOIN marks ON marks.doc_id = d.doc_id
), cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM judged GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
    SELECT concat(a.f, b.f, c.f, d.f, e.f) AS o FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (SELECT o, s, substr(o, s, 1) AS own, substr(o, 1, s - 1) AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS s)),
met AS (
    SELECT part, o, s, own, n, good, bad, fails = own AS alone, contains(fails, own) AS failing, translate(earlier, fails, '') <> earlier AS gone
    FROM cells, steps
), counted AS (
    SELECT part, o, s, own, sum(CASE WHEN gone OR failing THEN 0 ELSE n END) AS kept, sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN failing AND NOT gone THEN bad ELSE 0 END) AS toxic_lost
    FROM met GROUP BY part, o, s, own
)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """The code of every usable vector, its error and that of its label."""
    return vector_codes.compress(table(spark, folder, "embeddings"))


def _op13_sql() -> str:
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES

    def assign(at: int) -> str:
        return f"""near{at} AS (
    SELECT vec_id, part, arg_min(entry, far * {entries} + entry) AS entry, min(far) AS far
    FROM (SELECT vec_id, p.part, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far
          FROM parts p JOIN book{at} b ON p.part = b.part) GROUP BY vec_id, part
)"""

    def update(at: int) -> str:
        return f"""means{at} AS (
    SELECT part, entry, list(m ORDER BY place) AS c FROM (
        SELECT p.part, entry, place, CAST(floor(sum(x[place]) / count(*)) AS BIGINT) AS m
        FROM parts p JOIN near{at} USING (vec_id, part), (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS place) GROUP BY p.part, entry, place
    ) GROUP BY part, entry
), book{at + 1} AS (SELECT part, entry, coalesce(m.c, b.c) AS c FROM book{at} b LEFT JOIN means{at} m USING (part, entry))"""

    return f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), parts AS (
    SELECT vec_id, part, x[part * (len(x) // {parts}) + 1 : (part + 1) * (len(x) // {parts})] AS x FROM kept, (SELECT unnest(range({parts})) AS part)
), book0 AS (
    SELECT part, rank AS entry, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS rank FROM kept) USING (vec_id) WHERE rank < {entries}
), {assign(0)}, {update(0)}, {assign(1)}, {update(1)}, {assign(2)},
coded AS (
    SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM near2 GROUP BY vec_id
), digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""


QUERIES = (
    op1_token_counts, op2_best_fit_packing, op3_toxicity, op4_decontamination, op5_substring_dedup, op6_fingerprints, op7_near_duplicates,
    op8_quality_classifier, op9_line_dedup, op10_license_scan, op11_url_filter, op12_filter_audit, op13_vector_codes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": OP4_SQL,
        "op9_line_dedup": OP9_SQL,
        "op10_license_scan": _op10_sql(),
        "op12_filter_audit": OP12_SQL,
        "op13_vector_codes": _op13_sql(),
    }
