"""The queries of the operators for training text over the driver's tables.

SQL says op12 and op13 anew. It can express none of the others on whole tables (seeded 64-bit hashes, tokenizer
files, dictionaries of a compressor, suffix orders, jump hashes, covariance determinants): tests/llm holds each
against a brute-force version instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.session import load


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every document and of its edited text."""
    from lumenspan.llm import imatch

    return imatch.edited_fingerprints(load(spark, sf_dir, "documents"))


def op2_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written as Huffman-coded blocks and read back."""
    from lumenspan.llm import huffman

    return huffman.coded(load(spark, sf_dir, "documents")).drop("ids")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression-distance scores, learnt outside the held-out fold."""
    from lumenspan.llm import toxicity

    return toxicity.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 100-byte strings that start earlier."""
    from lumenspan.llm import suffixes

    return suffixes.digests(load(spark, sf_dir, "documents"))


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards by jump consistent hashing of doc_id."""
    from lumenspan.llm import sharding

    return sharding.shard(load(spark, sf_dir, "documents"), shards=16)


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    from lumenspan.llm import packing

    return packing.best_fit(load(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 made of control strings, formatted and read back."""
    from lumenspan.llm import chat

    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.formatted(rows.unionByName(extra)))


def op8_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of every document, and what they decode to."""
    from lumenspan.llm import nbest

    return nbest.digests(load(spark, sf_dir, "documents"), n=3)


def op9_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding rendered as a recording; recordings with ids divisible by 100 aligned against all."""
    from lumenspan.llm import chroma

    tunes = chroma.rendered(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return chroma.search(tunes, F.col("media_id") % 100 == 0)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and components of links at three bits or fewer."""
    from lumenspan.llm import simhash

    return simhash.near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every text, the base rules, and the verdict of robust distances in its language and source."""
    from lumenspan.llm import outliers

    return outliers.judged(load(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut into prefix, middle and suffix, written with marks and rebuilt."""
    from lumenspan.llm import fim

    return fim.digests(fim.transformed(load(spark, sf_dir, "documents")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of two or three words."""
    from lumenspan.llm import collocations

    return collocations.collocations(load(spark, sf_dir, "documents"))


OP12_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(w)::BIGINT AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS lo, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(w[1:lo], ''), '') AS a, coalesce(array_to_string(w[lo + 1:hi], ''), '') AS b, coalesce(array_to_string(w[hi + 1:n], ''), '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

OP13_SQL = r"""WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^ 	]+') AS w FROM piece),
g AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
f1 AS (SELECT lang, a AS phrase, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, a, b, a || ' ' || b AS phrase, count(*) AS f FROM g WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, a, b, c, a || ' ' || b || ' ' || c AS phrase, count(*) AS f FROM g WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
held AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, a || ' ' || b AS phrase, f FROM f3 UNION ALL SELECT lang, b || ' ' || c, f FROM f3) GROUP BY ALL),
cut AS (SELECT f2.lang, f2.phrase, f2.f AS a, x.f AS l, y.f AS r, 1 AS k FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.phrase = f2.a JOIN f1 y ON y.lang = f2.lang AND y.phrase = f2.b
    LEFT JOIN held ON held.lang = f2.lang AND held.phrase = f2.phrase WHERE held.f IS NULL OR 100 * held.f < 50 * f2.f
  UNION ALL SELECT f3.lang, f3.phrase, f3.f, x.f, y.f, 1 FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.phrase = f3.a JOIN f2 y ON y.lang = f3.lang AND y.phrase = f3.b || ' ' || f3.c
  UNION ALL SELECT f3.lang, f3.phrase, f3.f, x.f, y.f, 2 FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.phrase = f3.a || ' ' || f3.b JOIN f1 y ON y.lang = f3.lang AND y.phrase = f3.c),
s AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cut),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang) USING (lang) WHERE rank <= 2000"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_imatch, op2_token_codes, op3_toxicity, op4_repeats, op5_jump_shards, op6_best_fit, op7_chat, op8_nbest, op9_chroma, op10_simhash, op11_robust_outliers, op12_fill_in_middle, op13_collocations)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op12_fill_in_middle": OP12_SQL, "op13_collocations": OP13_SQL}
