"""Pages of hard-wrapped lines joined to running text, by the words of their document.

Defined cases: null text is empty and stays so; a null document id is an id like others; repeated pages all stay; an empty
table gives no rows; extra columns are kept. A page is in a worker's memory; a document never is, since a page gets only
those words of its document that end with what follows one of its hyphens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspan.session import ship, stored

# Results depend on exactly these.
LINE_ENDS = ".!?;。！？；"
WORD, PIECE, STEM = r"[A-Za-z][A-Za-z'\-]*", r"^[A-Za-z0-9][A-Za-z0-9'\-]*", r"([A-Za-z][A-Za-z'\-]*)-$"
WORD_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'-"
#: What follows a hyphen at the end of a line, if it can be part of a word; Python strips \x1c to \x1f as well.
BROKEN = r"(?U)(?<=-)[\s\x1c-\x1f&&[^\r\n]]*+[\r\n][\s\x1c-\x1f]*+([a-z][A-Za-z'\-]*+)(?![0-9])"
# End of fixed values.


def drops_hyphen(head: str, line: str, words: set[str]) -> bool:
    """Is the hyphen at the end of head one of layout? Names and numbers after it keep it; else it stays if the document has the hyphened word.

    Whether the document has the joined word as well changes nothing: the hyphen goes if only that or neither occurs.
    """
    piece, stem = re.match(PIECE, line), re.search(STEM, head)
    if piece is None or stem is None or piece.group()[0].isupper():
        return False
    return f"{stem.group(1)}-{piece.group()}".lower() not in words


def unwrap(text: str, words: set[str], ends: str = LINE_ENDS) -> str:
    """One page: lines that end with one of `ends` stay lines, the others go on in the next line."""
    out, parts, run = [], [], ""  # run: the signs of words at the end of what is joined so far
    for raw in re.split(r"\r\n|\r|\n", text):
        line = raw.strip()
        if not line:
            continue
        if run.endswith("-"):
            if drops_hyphen(run, line, words):
                parts[-1], run = parts[-1][:-1], run[:-1]
        elif parts:
            parts.append(" ")
            run = ""
        parts.append(line)
        rest = len(line.rstrip(WORD_SIGNS))
        run = line[rest:] if rest else run + line
        if line[-1] in ends:
            out.append("".join(parts))
            parts, run = [], ""
    return "\n".join([*out, "".join(parts)] if parts else out)


def unwrapped(pages: DataFrame, ends: str = LINE_ENDS) -> DataFrame:
    """pages(document_id, text, ...) with their text unwrapped; ends="" joins every line of a page."""
    ship(pages.sparkSession)
    rows = stored(pages.withColumns({"_row": F.monotonically_increasing_id(), "_document": F.coalesce(F.col("document_id").cast("string"), F.lit(""))}), "pages")
    asked = rows.select("_row", "_document", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(BROKEN), F.lit(1)), lambda x: F.lower(x)))).alias("piece"))
    hyphened = F.array_distinct(F.transform(F.filter(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: w.rlike("-[A-Za-z]")), lambda w: F.lower(w)))
    known = rows.select("_document", F.explode(hyphened).alias("word")).distinct()  # the only words that tell, few in running text
    starts = F.filter(F.sequence(F.lit(3), F.greatest(F.lit(3), F.length("word"))), lambda k: F.col("word").substr(k - 1, F.lit(2)).rlike("-[a-z]"))
    tails = known.select("_document", "word", F.explode(starts).alias("k")).select("_document", "word", F.expr("substring(word, k)").alias("piece"))
    words = tails.join(asked, ["_document", "piece"]).groupBy("_row").agg(F.collect_set("word").alias("_words"))  # by page: words that end as its breaks do
    words = stored(words, "words")  # texts are dealt by row only if it is too large to be sent
    both = rows.join(words, "_row", "left").select(*pages.columns, "_words")
    at = pages.columns.index("text")
    schema = T.StructType([f if f.name != "text" else T.StructField("text", T.StringType()) for f in pages.schema.fields])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())
            texts = pa.array([None if t is None else unwrap(t, set(w or ()), ends) for t, w in some], pa.string())
            columns = [texts if k == at else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return both.mapInArrow(join, schema)
