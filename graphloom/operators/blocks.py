"""Parsers of line-oriented model output, answers' footers and streamed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOOTER = "citations:"


def blocks(text: Column, head: str, field: str) -> Column:
    """``array<struct<key, value>>`` from lines ``HEAD: key`` each followed by ``FIELD: value``; a head without a field has a null value.

    Labels match without regard to case; lines that are neither are skipped, and so is a field without a head.
    """
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    is_a = lambda line, label: F.lower(line).startswith(F.lit(label.lower() + ":"))
    value = lambda line: F.trim(F.regexp_replace(line, "^[^:]*:", ""))
    empty = F.array().cast("array<struct<key:string,value:string>>")

    def step(acc: Column, line: Column) -> Column:
        n = F.size(acc)
        last = F.element_at(acc, -1)
        put = F.when((n > 0) & last["value"].isNull(), F.concat(F.slice(acc, F.lit(1), n - 1), F.array(F.struct(last["key"].alias("key"), value(line).alias("value"))))).otherwise(acc)
        return F.when(is_a(line, head), F.concat(acc, F.array(F.struct(value(line).alias("key"), F.lit(None).cast("string").alias("value"))))).when(is_a(line, field) & (n > 0), put).otherwise(acc)

    return F.aggregate(lines, empty, step)


def relation_label(value: Column) -> Column:
    """A relation in lower case; missing, empty or NONE mean ``none``."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v.isin("", "none"), "none").otherwise(v)


def _borders(word: str) -> list[int]:
    """For each beginning of ``word``, how long its longest proper end is that begins the word too."""
    out, k = [0], 0
    for c in word[1:]:
        while k and word[k] != c:
            k = out[k - 1]
        k += word[k] == c
        out.append(k)
    return out


_BORDERS = _borders(FOOTER)


class FooterFilter:
    """Passes streamed text on sign by sign, but holds back what may begin the footer, and swallows the footer and all behind it.

    What is held is as long as the part of the footer that matches so far, so a table of the
    footer's borders says how much of it may go when a sign doesn't fit.
    """

    def __init__(self, held: str = "", matched: bool = False):
        self.held, self.matched = held, matched

    def write(self, delta: str) -> str:
        out = []
        for c in "" if self.matched else delta:
            k = len(self.held)
            while k and FOOTER[k] != c.lower():
                out.append(self.held[: k - _BORDERS[k - 1]])
                k = _BORDERS[k - 1]
                self.held = self.held[len(self.held) - k :]
            if FOOTER[k] != c.lower():
                out.append(c)
                continue
            self.held += c
            if k + 1 == len(FOOTER):
                self.held, self.matched = "", True
                break
        return "".join(out)

    def flush(self) -> str:
        left, self.held = self.held, ""
        return left


def visible(stream: DataFrame) -> DataFrame:
    """Batch form: the text of each answer (``answer_id, seq, delta``) before its footer."""
    g = stream.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]), "").alias("t"))
    at = F.instr(F.lower("t"), FOOTER)
    return g.select("answer_id", F.when(at > 0, F.expr("left(t, instr(lower(t), 'citations:') - 1)")).otherwise(F.col("t")).alias("visible"))


def _whole(text: Column) -> Column:
    """An integer in decimal notation with an optional sign; null for anything else."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))


def numbered(text: Column, heads: list[str], field: str) -> Column:
    """``array<struct<ids, value>>``: the values of lines ``FIELD: value`` by the numbers of the heads above them, outer head first.

    Labels match as written. A head opens its level and closes the ones below it; a value counts
    only where all levels have a number. A number answered twice has its last value.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    k = len(heads)
    none = F.lit(None).cast("int")
    start = F.struct(F.array(*[none] * k).alias("at"), F.array().cast("array<struct<ids:array<int>,value:string>>").alias("out"))
    rest = lambda line, label: F.trim(F.substr(line, F.lit(len(label) + 2)))

    def step(acc: Column, line: Column) -> Column:
        at, out = acc["at"], acc["out"]
        known = F.forall(at, lambda x: x.isNotNull())
        put = F.concat(F.filter(out, lambda o: o["ids"] != at), F.array(F.struct(at.alias("ids"), rest(line, field).alias("value"))))
        new = F.when(line.startswith(field + ":") & known, put).otherwise(out)
        moved = at
        for i, head in reversed(list(enumerate(heads))):
            opened = F.array(*(at[j] for j in range(i)), _whole(rest(line, head)), *[none] * (k - i - 1))
            moved = F.when(line.startswith(head + ":"), opened).otherwise(moved)
        return F.struct(moved.alias("at"), new.alias("out"))

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


#: A theme without a label, and how many themes a run keeps.
UNTITLED, MOST_THEMES = "Untitled theme", 3


def themes(text: Column, sizes: Column) -> Column:
    """``struct<themes array<struct<id, label, summary, size>>, note>`` of a reply with blocks of ``COMMUNITY:``, ``LABEL:`` and ``SUMMARY:`` and a ``NOTE:``.

    ``sizes`` maps the ids that were offered to their member counts; blocks of other ids go.
    A reply without any theme has no note.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    item = "struct<id:int,label:string,summary:string>"
    null, empty = F.lit(None).cast(item), F.array().cast(f"array<{item}>")
    start = F.struct(null.alias("cur"), empty.alias("out"), F.lit("").alias("note"))
    rest = lambda line, label: F.trim(F.substr(line, F.lit(len(label) + 1)))

    def closed(acc: Column) -> Column:
        return F.when(acc["cur"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"])))

    def step(acc: Column, line: Column) -> Column:
        head, note = line.startswith("COMMUNITY:"), line.startswith("NOTE:")
        number = _whole(rest(line, "COMMUNITY:"))
        cur = acc["cur"]
        opened = F.when(number.isNotNull(), F.struct(number.alias("id"), F.lit("").alias("label"), F.lit("").alias("summary")))
        label = F.when(line.startswith("LABEL:"), rest(line, "LABEL:")).otherwise(cur["label"])
        summary = F.when(line.startswith("SUMMARY:"), rest(line, "SUMMARY:")).otherwise(cur["summary"])
        filled = F.when(cur.isNotNull(), F.struct(cur["id"].alias("id"), label.alias("label"), summary.alias("summary")))
        now = F.when(head, opened).when(note, null).otherwise(filled)
        return F.struct(now.cast(item).alias("cur"), F.when(head | note, closed(acc)).otherwise(acc["out"]).alias("out"), F.when(note, rest(line, "NOTE:")).otherwise(acc["note"]).alias("note"))

    end = F.aggregate(lines, start, step, lambda acc: F.struct(closed(acc).alias("found"), acc["note"].alias("note")))
    valid = F.filter(end["found"], lambda t: sizes[t["id"]].isNotNull())
    named = F.transform(valid, lambda t: F.struct(t["id"].alias("id"), F.when(t["label"] == "", UNTITLED).otherwise(t["label"]).alias("label"), t["summary"].alias("summary"), sizes[t["id"]].alias("size")))
    kept = F.slice(named, 1, MOST_THEMES)
    return F.struct(kept.alias("themes"), F.when(F.size(kept) > 0, end["note"]).otherwise("").alias("note"))
