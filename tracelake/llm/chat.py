"""Chat formatting: roles of transcript lines by a hidden Markov model.

A transcript is the lines of a conversation's rows, in order. A line shows a
speaker marker (``User:``, ``### Assistant``, ``<|system|>``) or none, and some
features: its length, whether it asks, whether a blank line precedes it. The
hidden states are the roles, each once as the beginning of a turn and once
inside it. The most probable states, by Viterbi, give the turns, which are
rendered in one form whatever the source's. Roles aren't an input; a model is
counted from labelled transcripts, on executors.

A long conversation is cut into segments. The best scores from every state
before a segment to every state at its end form a matrix; those matrices are
chained in order of the segments, which fixes the states at the cuts, and then
segments are decoded side by side. That is Viterbi exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.shared import written
from tracelake.session import share_code

ROLES = ["system", "user", "assistant", "tool"]
STATES = 2 * len(ROLES)  # role r begins in state r and goes on in state r + 4
NAMES = {
    "system": "system instruction instructions context",
    "user": "user human customer prompter question q client me",
    "assistant": "assistant ai bot gpt chatgpt agent model answer a support",
    "tool": "tool function observation result output",
}
ROLE_OF = {name: i for i, role in enumerate(ROLES) for name in NAMES[role].split()}
WORDS = "|".join(sorted(ROLE_OF, key=len, reverse=True))
#: A marker at a line's start: a name between brackets or behind hashes, or
#: before a colon.
MARKER = re.compile(
    rf"\s*(?:<\|(?P<a>{WORDS})\|>|\[(?P<b>{WORDS})\]\s*:?|#{{1,6}}\s*(?P<c>{WORDS})\s*(?::|$)|\**(?P<d>{WORDS})\**\s*:\**)\s*", re.IGNORECASE
)
KINDS = 3 * 2 * 2  # line features: length in three classes, whether it asks, whether it follows a blank line
#: Rows in a segment; from so many rows in one it is cut further.
SEGMENT, HOT = 512, 4096


def role_number(name: str | None) -> int:
    """The role that a declared name stands for, -1 if none."""
    return ROLE_OF.get((name or "").strip().lower(), -1)


def role_of(name: Column) -> Column:
    """``role_number`` over a column."""
    pairs = [x for kv in ROLE_OF.items() for x in kv]
    known = F.create_map(*map(F.lit, pairs))
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_replace(name, "^\\s+|\\s+$", ""))), F.lit(-1))


@dataclass
class Lines:
    """What is seen of some rows: the row and text of each line that isn't
    blank, behind its marker, with the blank lines before it (within its row);
    its marker (-1: none) and its kind."""

    row: list[int]
    text: list[str]
    blanks: list[int]
    marker: np.ndarray
    kind: np.ndarray


def observe(texts: list[str | None]) -> Lines:
    """A row without any text has one empty line."""
    row, out, blanks, marker, kind = [], [], [], [], []
    for i, text in enumerate(texts):
        waiting = 0
        lines = (text or "").split("\n")
        if not any(map(str.strip, lines)):
            lines = [""]
        for line in lines:
            if not line.strip() and len(lines) > 1:
                waiting += 1
                continue
            m = MARKER.match(line)
            body = line[m.end() :] if m else line
            row.append(i)
            out.append(body)
            blanks.append(waiting)
            marker.append(ROLE_OF[next(g for g in m.groups() if g).lower()] if m else -1)
            size = 0 if len(body) < 60 else 1 if len(body) < 240 else 2
            kind.append(4 * size + 2 * body.rstrip().endswith("?") + (waiting > 0))
            waiting = 0
    return Lines(row, out, blanks, np.array(marker, np.int64), np.array(kind, np.int64))


@dataclass
class Model:
    """Logarithms: start[state], step[state, state], kind[state, kind],
    marker[state, marker + 1]."""

    start: np.ndarray
    step: np.ndarray
    kind: np.ndarray
    marker: np.ndarray

    def emissions(self, lines: Lines) -> np.ndarray:
        """Log chances of each line in each state."""
        return (self.kind[:, lines.kind] + self.marker[:, lines.marker + 1]).T


#: What is counted: a role's turns and lines inside turns, kinds and markers of
#: lines by state, the role after a role, the first role.
COUNTS = "what string, a int, b int, n long"


def line_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts over rows (role number, text), each a turn."""
    for batch in batches:
        found: dict[tuple[str, int, int], int] = {}
        for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lines = observe([text])
            for k, (kind, marker) in enumerate(zip(lines.kind.tolist(), lines.marker.tolist(), strict=True)):
                state = r if k == 0 else r + len(ROLES)
                for key in (("kind", state, kind), ("marker", state, marker + 1)):
                    found[key] = found.get(key, 0) + 1
            for key, n in ((("inside", r, 0), len(lines.text) - 1), (("inside", r, 1), 1)):
                found[key] = found.get(key, 0) + n
        if found:
            columns = [*zip(*found, strict=True), list(found.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["what", "a", "b", "n"])


def from_counts(counts: list[tuple[str, int, int, int]]) -> Model:
    """The model of counts, one added to each; a marker is as likely to
    mislead in any state as one line in a thousand."""
    n = len(ROLES)
    start, follow, inside = np.ones(n), np.ones((n, n)), np.ones((n, 2))
    kind, marker = np.ones((STATES, KINDS)), np.ones((STATES, n + 1))
    tables = {"first": start[:, None], "follow": follow, "inside": inside, "kind": kind, "marker": marker}
    for what, a, b, count in counts:
        tables[what][a, b] += count
    stay = inside[:, 0] / inside.sum(axis=1)
    follow /= follow.sum(axis=1, keepdims=True)
    step = np.zeros((STATES, STATES))
    for r in range(n):
        for state in (r, r + n):
            step[state, :n] = (1 - stay[r]) * follow[r]
            step[state, r + n] = stay[r]
    marker = 0.999 * marker / marker.sum(axis=1, keepdims=True) + 0.001 / (n + 1)
    with np.errstate(divide="ignore"):
        first = np.concatenate([np.log(start / start.sum()), np.full(n, -np.inf)])
        return Model(first, np.log(step), np.log(kind / kind.sum(axis=1, keepdims=True)), np.log(marker))


def viterbi(model: Model, seen: np.ndarray, enter: int | None = None, leave: int | None = None) -> np.ndarray:
    """The best states; after state ``enter``, ending in ``leave``, if given.
    Where no path is possible at a row's end, ``leave`` is free."""
    n = len(seen)
    back = np.zeros((n, STATES), np.int8)
    score = (model.start if enter is None else model.step[enter]) + seen[0]
    for t in range(1, n):
        ways = score[:, None] + model.step
        back[t] = ways.argmax(axis=0)
        score = ways[back[t], np.arange(STATES)] + seen[t]
    path = np.empty(n, np.int64)
    path[-1] = score.argmax() if leave is None else leave
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def transfer(model: Model, seen: np.ndarray) -> np.ndarray:
    """Best scores through the lines: row s from state s before them, the last
    row from the conversation's start, to the state at the end."""
    score = np.concatenate([model.step, model.start[None]]) + seen[0]
    for t in range(1, len(seen)):
        score = (score[:, :, None] + model.step[None]).max(axis=1) + seen[t]
    return score


def boundaries(matrices: list[np.ndarray]) -> list[int]:
    """The state at the end of each segment on the best path through all."""
    score, back = matrices[0][STATES], []
    for m in matrices[1:]:
        ways = score[:, None] + m[:STATES]
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def render(role: str, text: str) -> str:
    """The canonical form of a turn. Delimiters in the text are taken apart."""
    return f"<|im_start|>{role}\n{text.replace('<|', '< |')}<|im_end|>\n"


KEYS = ["conv", "c", "t", "s"]
ORDER = ["turn", "h"]
OUT = "conv {conv}, conv_id {id}, turn {turn}, part int, role string, begins boolean, text string, rendered string, copies long"


def pieces_of(lines: Lines, path: list[int]) -> list[tuple[int, int, str, bool, str]]:
    """Pieces (row, part, role, begins, text): the lines of a row that belong
    to one turn. A piece that doesn't begin goes on with the turn of the row
    before. Blank lines stay inside a piece, not around it."""
    out: list[list] = []
    for row, text, blanks, state in zip(lines.row, lines.text, lines.blanks, path, strict=True):
        new_row = not out or out[-1][0] != row
        if new_row or state < len(ROLES):
            out.append([row, 0 if new_row else out[-1][1] + 1, ROLES[state % len(ROLES)], state < len(ROLES), [text]])
        else:
            out[-1][4] += [""] * blanks + [text]
    # a marker may stand on a line of its own
    return [(row, part, role, begins, "\n".join(t[1:] if len(t) > 1 and not t[0] else t)) for row, part, role, begins, t in out]


def _segments(frame: pd.DataFrame):
    for key, own in frame.sort_values([*KEYS, *ORDER], kind="stable", na_position="first").groupby(KEYS, sort=False, dropna=False):
        yield key, own, observe(own["text"].tolist())


def segmented(rows: DataFrame, segment: int, hot: int) -> DataFrame:
    """Rows with their segment (KEYS), written. Segments are ranges of turns,
    counted from the conversation's first; one of more than ``hot`` rows is cut
    at every turn, and a turn of many rows by ranges of their hash."""
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = written(rows, "turns")
    first = written(rows.groupBy("conv").agg(F.min("turn").alias("first")), "first")
    rows = rows.join(first, "conv").withColumn("c", F.coalesce(F.floor((F.col("turn") - F.col("first")) / segment), F.lit(-1)).cast("long"))
    sizes = written(rows.groupBy("conv", "c").agg(F.count("*").alias("n")).where(F.col("n") > hot), "sizes")
    rows = rows.join(sizes, ["conv", "c"], "left").withColumn("k", F.ceil(F.col("n") / segment))
    step = F.floor(F.lit(float(1 << 64)) / F.col("k"))
    rows = rows.withColumns(
        {
            "t": F.when(F.col("n").isNotNull(), F.coalesce(F.col("turn") - F.col("first"), F.lit(-1))).otherwise(F.lit(0)).cast("long"),
            "s": F.coalesce(F.floor((F.col("h").cast("double") + float(1 << 63)) / step), F.lit(0)).cast("long"),
        }
    ).drop("n", "k", "first")
    return written(rows, "segments")


def prepared(df: DataFrame, conv_col: str, turn_col: str, text_col: str, *others: Column) -> DataFrame:
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).alias("text"), *others)
    alone = F.concat(F.lit("null "), F.xxhash64("turn", "text").cast("string"))
    return rows.withColumn("conv", F.coalesce(F.concat(F.lit("id "), F.col("conv_id").cast("string")), alone))


def fit(
    labelled: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT, hot: int = HOT
) -> Model:
    """A model counted over all labelled rows, each a turn as a transcript
    shows it. Rows of unknown role don't count; the role after a role is
    counted within segments. Without labelled rows chances are even."""
    share_code(labelled.sparkSession)
    rows = segmented(prepared(labelled, conv_col, turn_col, text_col, role_of(F.col(role_col)).alias("r")), segment, hot)
    known = rows.where("r >= 0")
    counts = known.select("r", "text").mapInArrow(line_counts, COUNTS)
    before = F.lag("r").over(Window.partitionBy(*KEYS).orderBy(*ORDER, "r"))
    pairs = rows.select(before.alias("a"), F.col("r").alias("b")).where("a >= 0 and b >= 0")
    counts = counts.unionByName(pairs.select(F.lit("follow").alias("what"), "a", "b", F.lit(1).cast("long").alias("n")))
    first = rows.groupBy("conv").agg(F.min_by("r", F.struct(*ORDER, "r")).alias("a")).where("a >= 0")
    counts = counts.unionByName(first.select(F.lit("first").alias("what"), "a", F.lit(0).alias("b"), F.lit(1).cast("long").alias("n")))
    found = counts.groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()  # a few hundred numbers
    return from_counts([(r["what"], r["a"], r["b"], r["n"]) for r in found])


#: Markers by style of a transcript, before a turn's text; the styles up to
#: SPACED part turns by blank lines.
STYLES = ["{0}: ", "### {0}\n", "<|{0}|> ", "**{0}**: ", "[{0}] "]
SPACED = 3
SHOWN = {"system": ["System", "Context"], "user": ["User", "Human"], "assistant": ["Assistant", "AI"], "tool": ["Tool", "Result"]}
#: One marker of so many is missing.
MISSING = 5


def transcripts(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text): each row's text as its conversation's
    transcript shows it. A hash of the conversation chooses the style and the
    names of speakers; a hash of the turn's text leaves markers out."""
    role, conv = role_of(F.col(role_col)), F.coalesce(F.col(conv_col).cast("string"), F.lit(""))
    style = F.pmod(F.xxhash64(conv), F.lit(len(STYLES)))
    which = F.pmod(F.xxhash64(conv, F.lit(1)), F.lit(2))
    marker = F.lit("")
    for k, form in enumerate(STYLES):
        for r, names in enumerate(SHOWN.values()):
            for j, name in enumerate(names):
                marker = F.when((style == k) & (role == r) & (which == j), form.format(name)).otherwise(marker)
    shown = F.pmod(F.xxhash64(conv, text_col, F.lit(2)), F.lit(MISSING)) > 0
    text = F.concat(F.when(style < SPACED, "\n").otherwise(""), F.when(shown, marker).otherwise(""), F.coalesce(text_col, F.lit("")))
    return conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), text.alias("text"))


def parse(
    lines: DataFrame, model: Model, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", segment: int = SEGMENT, hot: int = HOT
) -> DataFrame:
    """Rows (conv_id, turn, part, role, begins, text, rendered, copies): the
    pieces of turns in each row of a transcript, with their recovered role.

    Rows are in order of ``turn`` (nulls first), equal turns in order of a hash
    of their text; rows equal in all three columns are one, ``copies`` tells
    how many. Only the order of turns matters, not their numbers' origin. A row
    may hold one turn, several, a part of one, or a whole conversation. A null
    text is one empty line; a row with a null conversation is a conversation
    alone. Other columns, a role among them, aren't read.
    """
    spark = lines.sparkSession
    share_code(spark)
    rows = prepared(lines, conv_col, turn_col, text_col)
    rows = segmented(rows.groupBy("conv", "conv_id", "turn", "text").agg(F.count("*").alias("copies")), segment, hot)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    groups = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("g", F.pmod(F.xxhash64(*KEYS), F.lit(groups)))
    counts = rows.select(*KEYS).distinct().groupBy("conv").agg(F.count("*").alias("segments")).where("segments > 1")
    counts = written(counts, "long")

    def matrices(frame: pd.DataFrame) -> pd.DataFrame:
        out = [(*key, transfer(model, model.emissions(lines)).reshape(-1).tolist()) for key, _, lines in _segments(frame)]
        return pd.DataFrame(out, columns=[*KEYS, "m"])

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(KEYS)
        ends = boundaries([np.array(m, float).reshape(STATES + 1, STATES) for m in frame["m"]])
        return frame[KEYS].assign(enter=[-1, *ends[:-1]], leave=ends)

    long = rows.join(counts.select("conv"), "conv", "left_semi")
    key_types = ", ".join(f"{k} {kinds[k]}" for k in KEYS)
    cuts = long.groupBy("g").applyInPandas(matrices, f"{key_types}, m array<double>")
    cuts = written(cuts.groupBy("conv").applyInPandas(chain, f"{key_types}, enter int, leave int"), "cuts")

    def decode(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own, lines in _segments(frame):
            enter, leave = own["enter"].iloc[0], own["leave"].iloc[0]
            path = viterbi(model, model.emissions(lines), None if pd.isna(enter) or enter < 0 else int(enter), None if pd.isna(leave) else int(leave))
            head = list(zip(own["conv"], own["conv_id"], own["turn"], own["copies"], strict=True))
            for row, part, role, begins, text in pieces_of(lines, path.tolist()):
                conv, conv_id, turn, copies = head[row]
                out.append((conv, conv_id, turn, part, role, begins, text, render(role, text), copies))
        names = ["conv", "conv_id", "turn", "part", "role", "begins", "text", "rendered", "copies"]
        found = pd.DataFrame(out, columns=names)
        return found.astype({"turn": "Int64"}) if len(found) else found

    schema = OUT.format(conv=kinds["conv"], id=kinds["conv_id"], turn=kinds["turn"])
    out = rows.join(cuts, KEYS, "left").groupBy("g").applyInPandas(decode, schema)
    return out.select(F.col("conv_id").alias(conv_col), F.col("turn").alias(turn_col), "part", "role", "begins", "text", "rendered", "copies")
