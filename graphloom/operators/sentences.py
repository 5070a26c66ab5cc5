"""Sentences of passages with byte offsets, and the running sums that offsets need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[ \t\r\n\f]"
_CLOSING = "[\"')\\]»”’]"
#: Words whose full stop ends no sentence, beside single capitals (initials).
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Sr", "Jr", "vs", "cf", "e\\.g", "i\\.e", "z\\.B"]
#: Text up to a stop with space behind it, a full-width stop, an empty line or the end. Every
#: repetition behind the first is possessive and starts at a run's first sign only, so that no
#: run of dots or spaces is looked at twice; the look ahead spares other signs the looks behind.
SENTENCE = (
    f"(?s).*?(?:(?=[.!?])(?<![.!?])(?:[.!?]{{2,}}+|[!?]|(?<!(?<![A-Za-z])(?:[A-Z]|{'|'.join(ABBREVIATIONS)}))\\.){_CLOSING}*+{_SPACE}++"
    f"|[。！？]++{_SPACE}*+|\\n[ \\t\\r\\f]*+\\n{_SPACE}*+|\\z)"
)
#: Elements that are summed in one piece; pieces are put together at the end, so that no long list is copied for each element.
_RUN = 256


def _named(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def sums_before(lengths: Column) -> Column:
    """For an array of ints, the array of the sums of all elements before each one (0 first).

    Two levels of runs keep the copies of a growing list short: a list of n elements costs
    n * 128 copies within runs and n * n / 131,072 of references between them.
    """
    none = lambda kind: F.array().cast(f"array<{kind}>")
    state = lambda s, w: F.struct(s.alias("s"), w.alias("w"))

    def summed(every: Column) -> Column:
        def run(j: Column, before: Column) -> Column:
            part = F.slice(every, j * _RUN + 1, _RUN)
            return F.aggregate(part, state(before, none("int")), lambda a, x: state(a["s"] + x, F.array_append(a["w"], a["s"])))

        join = lambda o, j: _named(run(j, o["s"]), lambda y: state(y["s"], F.array_append(o["w"], y["w"])))
        runs = F.sequence(F.lit(0), F.floor(F.size(every) / _RUN).cast("int"))
        many = F.aggregate(runs, state(F.lit(0), none("array<int>")), join, lambda o: F.flatten(o["w"]))
        return F.when(F.size(every) <= _RUN, run(F.lit(0), F.lit(0))["w"]).otherwise(many)

    return _named(lengths, summed)


def byte_starts(parts: Column) -> Column:
    """For an array of strings that follow each other in a text, the byte offset of each."""
    return sums_before(F.transform(parts, lambda x: F.octet_length(x)))


def sentence_list(text: Column) -> Column:
    """The sentences of a text in order, with the space behind each; together they are the text.

    What stands before the first stop or behind the last is a sentence as well, so windows that
    begin or end inside one lose nothing. Null gives null, an empty text an empty list.
    """
    return F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda x: x != "")


def sentences(chunks: DataFrame) -> DataFrame:
    """``chunk_id, sentence`` (from 0), ``text, char_start, char_end`` (bytes in the chunk, end exclusive) of every sentence.

    Rows that share an id are cut one by one. Null and empty texts give no rows.
    """
    c = chunks.select("chunk_id", sentence_list(F.col("text")).alias("t")).select("chunk_id", "t", byte_starts(F.col("t")).alias("s"))
    c = c.select("chunk_id", F.posexplode(F.arrays_zip("t", "s")).alias("sentence", "z"))
    return c.select("chunk_id", "sentence", F.col("z.t").alias("text"), F.col("z.s").alias("char_start"), (F.col("z.s") + F.octet_length("z.t")).alias("char_end"))


def pattern_matches(pattern: str):
    """A finder for :func:`found`: the matches of a pattern in a sentence with their byte offsets, in one pass over gaps and matches."""

    def placed(both: Column) -> Column:
        # A match begins behind its gap, which begins behind the gaps and matches before it.
        behind = sums_before(F.transform(both["m"], lambda m, i: F.octet_length(F.get(both["p"], i)) + F.octet_length(m)))
        return F.transform(F.arrays_zip(both["m"].alias("m"), behind.alias("b")), lambda z, i: F.struct(z["m"].alias("m"), (z["b"] + F.octet_length(F.get(both["p"], i))).alias("s")))

    def find(sentence: Column) -> Column:
        # Most sentences have no match; they are not split.
        pieces = lambda m: _named(F.struct(m.alias("m"), F.split(sentence, pattern, -1).alias("p")), placed)
        return _named(F.regexp_extract_all(sentence, F.lit(f"({pattern})"), F.lit(1)), lambda m: F.when(F.size(m) > 0, pieces(m)).otherwise(F.array().cast("array<struct<m:string,s:int>>")))

    return find


def found(text: Column, find) -> Column:
    """What ``find`` sees in each sentence of a text, as one list of ``m`` (text) and ``s`` (byte offset in the whole text).

    ``find`` takes a sentence and returns such a list with offsets in the sentence; it is the
    place for a model. A null text gives null, one in which nothing is found an empty list.
    """

    def each(whole: Column) -> Column:
        rebased = lambda x: F.transform(find(x["t"]), lambda y: F.struct(y["m"].alias("m"), (y["s"] + x["s"]).alias("s")))
        return F.flatten(F.transform(F.arrays_zip(whole.alias("t"), byte_starts(whole).alias("s")), rebased))

    return _named(sentence_list(text), each)
