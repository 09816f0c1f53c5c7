"""Line deduplication by overlapping windows of three lines.

Every three consecutive lines of a document form a window.  Of equal windows the
first (smallest doc_id, then position) stays; each later one marks its three
lines, and marked positions of a document are merged and removed.  Windows are
compared by 128 hash bits of their content, without the spaces and the newline
that end a line.

A text is cut at newlines, and a line further so that long passages hold several
windows: at the first sentence end after eight words, and after sixteen words at
the latest.  So a repeated line of over 32 words is found wherever it stands.  A
passage inside a line is found where its cuts fall together with those of the
other line, most often after its first sentence ends; one without any sentence end
that starts in the middle of a line may stay.  The cut lines of a text put together
are the text, so what is not removed stays as it was; where the last line goes, the
newline before it goes too.

Documents of fewer than three lines have no window and stay as they are; null texts
stay null, empty ones empty, an empty table gives an empty one.  Rows that share an
id are one document, their windows count once.  A null id comes before all others.
Texts of any length take time linear in their length.  Columns called as the
results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import checkpointed

LINES = 3
# One line, or the part of it up to a cut, with what ends it.
LINE = r"(?:[^ \n]+ +){0,7}(?:[^ \n]*[^ \n.!?] +){0,8}[^ \n]* *\n?"


def cut_lines(text: str | Column) -> Column:
    """The lines of a text, long ones in parts, each with the spaces and the newline that end it."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.filter(F.regexp_extract_all(text, F.lit(LINE), F.lit(0)), lambda x: x != "")
    return F.when((text == "") | text.endswith("\n"), F.array_append(found, F.lit(""))).otherwise(found)


def repeated_positions(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """(doc_id, gone): positions of the lines that later occurrences of a window cover."""
    content = F.transform(cut_lines(docs[text]), lambda x: F.rtrim(x, F.lit(" \n")))
    hashes = F.transform(content, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(lines), x).alias("g")))
    split = docs.select(docs[doc_id].alias("id"), hashes.alias("l")).filter(F.size("l") >= lines)

    def window(p: Column) -> Column:
        parts = [F.get("l", p + k) for k in range(lines)]
        return F.struct(F.xxhash64(*[x["h"] for x in parts]).alias("h"), F.xxhash64(*[x["g"] for x in parts]).alias("g"))

    windows = F.transform(F.sequence(F.lit(0), F.size("l") - lines), window)
    places = split.select("id", F.posexplode(windows).alias("p", "w")).select("id", "p", "w.h", "w.g")
    at = F.struct("id", "p")
    firsts = places.groupBy("h", "g").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first <> last").select("h", "g", "first")
    later = places.join(checkpointed(firsts), ["h", "g"]).filter(~(at == F.col("first")))
    covered = later.select("id", F.explode(F.sequence(F.col("p"), F.col("p") + (lines - 1))).alias("p")).distinct()
    return covered.groupBy("id").agg(F.collect_set("p").alias("gone")).select(F.col("id").alias("doc_id"), "gone")


def drop_repeated_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """``docs`` with the cleaned text, and the number of lines before and of those removed (``n_lines``, ``n_removed``)."""
    gone = repeated_positions(docs, doc_id=doc_id, text=text, lines=lines).select(F.col("doc_id").alias("__id"), F.col("gone").alias("__gone"))
    joined = docs.join(gone, docs[doc_id].eqNullSafe(gone["__id"]), "left")
    others = [docs[c] for c in docs.columns if c not in (text, "n_lines", "n_removed")]

    def cleaned(every: Column) -> Column:
        last = F.size(every) - 1
        left = F.array_except(F.sequence(F.lit(0), last), "__gone")
        rest = F.array_join(F.transform(left, lambda i: F.get(every, i)), "")
        clean = F.when(F.array_contains("__gone", last), F.regexp_replace(rest, "\\n\\z", "")).otherwise(rest)
        touched = F.col("__gone").isNotNull() & every.isNotNull()
        return F.struct(
            F.when(touched, clean).otherwise(docs[text]),
            F.when(every.isNull(), 0).otherwise(F.size(every)),
            F.when(touched, F.size(every) - F.size(left)).otherwise(0),
        )

    # A list of one: its element is cut once, however often the parts below read it.
    return joined.select(*others, F.inline(F.transform(F.array(cut_lines(docs[text])), cleaned)).alias(text, "n_lines", "n_removed"))
