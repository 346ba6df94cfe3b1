"""Queries over cleaning, checksums, fingerprints, duplicate pairs and plateaus, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import dedup, fingerprint, plateau
from quillgraph.plans import tables
from quillgraph.plans.retrieval_queries import WORDS

_SPACE = r"[ \t\n\r\f\x0B]+"
_PUNCT = T.PUNCTUATION.replace("'", "''")
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)

CLEAN = rf"""
lines AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_SPACE}|{_SPACE}$', '', 'g')) AS lines FROM documents),
body AS (SELECT doc_id, len(lines) AS n, lines[3:] AS body FROM lines),
titled AS (SELECT doc_id, n, CASE WHEN len({WORDS.format("coalesce(body[1], '')")}) <= 7 THEN body[2:] ELSE body END AS body FROM body),
clean AS (SELECT doc_id, CASE WHEN n >= 3 THEN coalesce(array_to_string(list_transform(list_filter(body, lambda x: x <> ''), lambda x: translate(x, '{_PUNCT}', '')), ' '), '') END AS clean FROM titled)"""

ADLER = """
bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::INT) AS c FROM documents),
sums AS (SELECT doc_id, (1 + coalesce(list_sum(c), 0)) % 65521 AS low, (len(c) + coalesce(list_sum(list_transform(c, lambda x, i: (len(c) - i + 1) * x::BIGINT)), 0)) % 65521 AS high FROM bytes)"""

MANUAL = """
bytes AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(hex(encode(clean)), '..'), lambda h: ('0x' || h)::INT), lambda x: x <> 32) AS c FROM clean WHERE clean IS NOT NULL),
sums AS (SELECT doc_id, coalesce(list_sum(c), 0) % 65521 AS low, coalesce(list_sum(list_transform(c, lambda x, i: (len(c) - i + 1) * x::BIGINT)), 0) % 65521 AS high FROM bytes)"""


def prints_sql(source: str) -> str:
    """CTEs up to prints(id, bits, print) from a CTE ``source``(id, words)."""
    return f"""
counted AS (SELECT id, word, count(*) AS tf FROM (SELECT id, unnest(words) AS word FROM {source}) WHERE word NOT IN ({_STOP}) GROUP BY ALL),
hashed AS (SELECT word, list_transform(range(128), lambda i: (((strpos('0123456789abcdef', md5(word)[(i // 4 + 1):(i // 4 + 1)]) - 1) >> (3 - i % 4)) & 1)::INT) AS bits FROM (SELECT DISTINCT word FROM counted)),
signed AS (SELECT word, unnest(range(128)) AS i, unnest(bits) AS bit, list_position(bits, 1) - 1 AS first FROM hashed),
voted AS (SELECT id, i, sum(CASE WHEN i < first THEN 0 WHEN bit = 1 THEN tf ELSE -tf END) > 0 AS one FROM counted JOIN signed USING (word) GROUP BY id, i),
digits AS (SELECT id, i // 4 AS digit, sum(one::INT << (3 - i % 4)) AS d FROM voted GROUP BY ALL),
packed AS (SELECT id, string_agg('0123456789abcdef'[(d + 1)::INT:(d + 1)::INT], '' ORDER BY digit) AS print FROM digits GROUP BY id),
bitted AS (SELECT id, string_agg(one::INT::VARCHAR, '' ORDER BY i) AS bits FROM voted GROUP BY id),
prints AS (SELECT s.id, coalesce(bits, '') AS bits, coalesce(print, '') AS print FROM {source} s LEFT JOIN packed USING (id) LEFT JOIN bitted USING (id))"""


BANDS = """
bands AS (SELECT id, unnest(range(32)) AS band, unnest(string_split(print, '')) AS digit FROM prints WHERE print <> ''),
pairs AS (SELECT a.id AS id_a, b.id AS id_b FROM bands a JOIN bands b ON a.band = b.band AND a.digit = b.digit AND a.id < b.id GROUP BY ALL HAVING 32 - count(*) <= 4)"""
BITS = """
pairs AS (SELECT a.id AS id_a, b.id AS id_b FROM prints a JOIN prints b ON a.id < b.id AND (a.print = '' OR b.print = '' OR CASE WHEN a.print <> '' AND b.print <> '' THEN hamming(a.bits, b.bits) <= 4 END))"""

SPEECHES = f"{CLEAN}, speeches AS (SELECT doc_id AS id, {WORDS.format('clean')} AS words FROM clean WHERE clean IS NOT NULL)"

#: Numeric texts: a customer's lines in order, each the words of the part's name and the quantity.
NUMERIC = r"""
numeric_texts AS (SELECT o_custkey AS id, string_split(string_agg(p_name || ' ' || l_quantity::BIGINT, ' ' ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity), ' ') AS words
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey)"""

PLATEAU = r"""
each AS (SELECT id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM numeric_texts),
flagged AS (SELECT id, pos, regexp_matches(word, '(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)$') AS num FROM each),
changed AS (SELECT id, pos, num, (num IS DISTINCT FROM lag(num) OVER (PARTITION BY id ORDER BY pos))::INT AS new FROM flagged),
numbered AS (SELECT id, num, sum(new) OVER (PARTITION BY id ORDER BY pos) - 1 AS run FROM changed),
sized AS (SELECT id, run::INT AS run, num, count(*) AS size FROM numbered GROUP BY ALL),
runs AS (SELECT id, run, num, sum(size) OVER w AS through, sum(CASE WHEN num THEN 0 ELSE size END) OVER w AS tags, sum(CASE WHEN num THEN size ELSE 0 END) OVER w AS nums,
  sum(CASE WHEN num THEN 0 ELSE size END) OVER (PARTITION BY id) AS all_tags, count(*) OVER (PARTITION BY id) AS n FROM sized WINDOW w AS (PARTITION BY id ORDER BY run)),
ends AS (SELECT a.id, a.run AS a, b.run AS b, a.tags + 100 * (b.nums - a.nums) + (b.all_tags - b.tags) AS score FROM runs a JOIN runs b ON a.id = b.id AND a.run <= b.run
  WHERE a.num AND b.num AND a.run <= a.n - 2 AND b.run <= b.n - 2),
best AS (SELECT id, a, b, score FROM ends WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, a, b) = 1),
chosen AS (SELECT id, coalesce(score, 0) AS score, coalesce(a, 0) AS a, coalesce(b, n - 1) AS b FROM (SELECT id, max(n) AS n, bool_or(num) AS has_num FROM runs GROUP BY id) LEFT JOIN best USING (id) WHERE has_num),
cut AS (SELECT c.id, c.score, c.a, c.b, words[x.through::BIGINT:y.through::BIGINT] AS plateau FROM chosen c JOIN runs x ON x.id = c.id AND x.run = c.a JOIN runs y ON y.id = c.id AND y.run = c.b JOIN numeric_texts t ON t.id = c.id),
spans AS (SELECT * FROM cut WHERE len(list_filter(plateau, lambda w: regexp_matches(w, '(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)$'))) >= 3)"""


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents").select("doc_id", T.clean_speech(F.col("text")).alias("clean"))


def _speeches(spark: SparkSession, sf: str) -> DataFrame:
    return _clean(spark, sf).where("clean is not null").select(F.col("doc_id").alias("id"), T.tokens(F.col("clean")).alias("words"))


def _prints(spark: SparkSession, sf: str) -> DataFrame:
    return _speeches(spark, sf).select("id", fingerprint.simhash(F.col("words")).alias("print"))


def _numeric(spark: SparkSession, sf: str) -> DataFrame:
    o = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id"))
    li = tables.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), "l_suppkey", "l_quantity")
    part = tables.table(spark, sf, "part").select("p_partkey", "p_name")
    word = F.concat_ws(" ", "p_name", F.col("l_quantity").cast("bigint").cast("string"))
    line = F.struct("l_orderkey", "l_linenumber", "p_partkey", "l_suppkey", "l_quantity", word.alias("word"))
    got = li.join(o, "l_orderkey").join(part, "p_partkey").groupBy("id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return got.select("id", F.split(F.array_join(F.col("lines.word"), " "), " ").alias("words"))


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return _clean(spark, sf)


def adler32(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.table(spark, sf, "documents").select("doc_id", T.adler32(F.col("text")).alias("adler"))
    return d.withColumn("signed", T.signed32(F.col("adler")))


def manual_checksum(spark: SparkSession, sf: str) -> DataFrame:
    return _clean(spark, sf).where("clean is not null").select("doc_id", T.manual_checksum(F.col("clean")).alias("checksum"))


def exact_dups_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.exact_pairs(_clean(spark, sf).where("clean is not null"), T.adler32(F.col("clean")), "doc_id", dedup.same_text(F.col("clean")))


def exact_dups_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.exact_pairs(_speeches(spark, sf), dedup.same_words(F.col("words")), "id")


def exact_dup_classes(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.exact_classes(_speeches(spark, sf), dedup.same_words(F.col("words")), "id")


def numeric_predicate(spark: SparkSession, sf: str) -> DataFrame:
    words = tables.table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word"))
    return words.where(T.is_number(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


def simhash_bits(spark: SparkSession, sf: str) -> DataFrame:
    return _prints(spark, sf)


def fingerprint_bands(spark: SparkSession, sf: str) -> DataFrame:
    return _prints(spark, sf).select("id", F.inline(fingerprint.bands(F.col("print"))))


def near_dups_bands(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_pairs(_prints(spark, sf))


def near_dups_hamming(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_pairs(_prints(spark, sf), bands=False)


def near_dup_lines(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.pair_lines(near_dups_bands(spark, sf))


def near_classes_bands(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_classes(_prints(spark, sf))


def near_classes_hamming(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_classes(_prints(spark, sf), bands=False)


def plateau_classes_bands(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_classes(_plateau_prints(spark, sf))


def plateau_classes_hamming(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_classes(_plateau_prints(spark, sf), bands=False)


def plateau_spans(spark: SparkSession, sf: str) -> DataFrame:
    return plateau.spans(_numeric(spark, sf)).withColumn("plateau", F.array_join("plateau", " "))


def _plateau_prints(spark: SparkSession, sf: str) -> DataFrame:
    return plateau.spans(_speeches(spark, sf)).select("id", fingerprint.simhash(F.col("plateau")).alias("print"))


def plateau_dups_bands(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_pairs(_plateau_prints(spark, sf))


def plateau_dups_hamming(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_pairs(_plateau_prints(spark, sf), bands=False)


_PAIRS = "SELECT a.id AS id_a, b.id AS id_b FROM {0} a JOIN {0} b ON a.{1} = b.{1} AND a.id < b.id"
_PLATEAUS = f"{SPEECHES}, numeric_texts AS (SELECT id, words FROM speeches), {PLATEAU}, plateaus AS (SELECT id, plateau AS words FROM spans)"

#: Classes of pairs: the smallest id reachable and the number of partners of each.
CLASSES = """
meet AS (SELECT id_a AS id, id_b AS other FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
reach(id, node) AS (SELECT DISTINCT id, id FROM meet UNION SELECT reach.id, meet.other FROM reach JOIN meet ON meet.id = reach.node)
SELECT id, class_id, links FROM (SELECT id, min(node) AS class_id FROM reach GROUP BY id) JOIN (SELECT id, count(*) AS links FROM meet GROUP BY id) USING (id)"""

QUERIES = {
    "clean_text": (clean_text, f"WITH {CLEAN} SELECT doc_id, clean FROM clean"),
    "adler32": (adler32, f"WITH {ADLER} SELECT doc_id, (high * 65536 + low)::BIGINT AS adler, CASE WHEN high >= 32768 THEN high * 65536 + low - 4294967296 ELSE high * 65536 + low END::BIGINT AS signed FROM sums"),
    "manual_checksum": (manual_checksum, f"WITH {CLEAN}, {MANUAL} SELECT doc_id, (high * 65536 + low)::BIGINT AS checksum FROM sums"),
    "exact_dups_fingerprint": (exact_dups_fingerprint, f"WITH {CLEAN}, c AS (SELECT doc_id AS id, clean FROM clean WHERE clean IS NOT NULL) " + _PAIRS.format("c", "clean")),
    "exact_dups_tokens": (exact_dups_tokens, f"WITH {SPEECHES} " + _PAIRS.format("speeches", "words")),
    "exact_dup_classes": (exact_dup_classes, f"WITH {SPEECHES} SELECT id, min(id) OVER (PARTITION BY words) AS class_id FROM speeches QUALIFY count(*) OVER (PARTITION BY words) > 1"),
    "numeric_predicate": (numeric_predicate, rf"SELECT word, count(*) AS n FROM (SELECT unnest({WORDS.format('text')}) AS word FROM documents) WHERE regexp_matches(word, '(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)$') GROUP BY word"),
    "simhash_bits": (simhash_bits, f"WITH {SPEECHES}, {prints_sql('speeches')} SELECT id, print FROM prints"),
    "fingerprint_bands": (fingerprint_bands, f"WITH {SPEECHES}, {prints_sql('speeches')} SELECT id, unnest(range(32))::INT AS band, unnest(string_split(print, '')) AS digit FROM prints WHERE print <> ''"),
    "near_dups_bands": (near_dups_bands, f"WITH {SPEECHES}, {prints_sql('speeches')}, {BANDS} SELECT * FROM pairs"),
    "near_dups_hamming": (near_dups_hamming, f"WITH {SPEECHES}, {prints_sql('speeches')}, {BITS} SELECT * FROM pairs"),
    "near_dup_lines": (near_dup_lines, f"WITH {SPEECHES}, {prints_sql('speeches')}, {BANDS} SELECT id_a || '-' || id_b AS line FROM pairs"),
    "near_classes_bands": (near_classes_bands, f"WITH RECURSIVE {SPEECHES}, {prints_sql('speeches')}, {BANDS}, {CLASSES}"),
    "near_classes_hamming": (near_classes_hamming, f"WITH RECURSIVE {SPEECHES}, {prints_sql('speeches')}, {BITS}, {CLASSES}"),
    "plateau_spans": (plateau_spans, f"WITH {NUMERIC}, {PLATEAU} SELECT id, score::BIGINT AS score, a::INT AS a, b::INT AS b, array_to_string(plateau, ' ') AS plateau FROM spans"),
    "plateau_dups_bands": (plateau_dups_bands, f"WITH {_PLATEAUS}, {prints_sql('plateaus')}, {BANDS} SELECT * FROM pairs"),
    "plateau_dups_hamming": (plateau_dups_hamming, f"WITH {_PLATEAUS}, {prints_sql('plateaus')}, {BITS} SELECT * FROM pairs"),
    "plateau_classes_bands": (plateau_classes_bands, f"WITH RECURSIVE {_PLATEAUS}, {prints_sql('plateaus')}, {BANDS}, {CLASSES}"),
    "plateau_classes_hamming": (plateau_classes_hamming, f"WITH RECURSIVE {_PLATEAUS}, {prints_sql('plateaus')}, {BITS}, {CLASSES}"),
}
