"""Parsing transcripts into turns with a hidden Markov model, and rendering them canonically.

A transcript is a run of lines. The state of a line is a role, whether the line opens a turn, and whether the
transcript marks all its turns; what is seen of a line are its speaker marker, whether it is empty, its length, how
it ends and whether the line before was empty. Counts over lines of known roles give the model; Viterbi finds the
likeliest states.

Lines are put in the order of transcripts by a range partitioning whose key ends in the row itself, so a transcript,
a turn number or a group of equal rows of any size is cut into partitions of bounded size. Transcripts that lie in
one partition are parsed there. What a partition boundary cuts is parsed as one all the same: the best scores
between all states at the two ends of a segment form a small matrix, the matrices of a transcript are chained,
and each segment is then traced back between the states found at its ends. That is Viterbi over the whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import settled, table

ROLES = ("system", "user", "assistant")
#: Words that stand for a role before a colon, or in brackets, of a line.
SPEAKERS = {
    "system": ("system", "sys", "instructions"),
    "user": ("user", "human", "customer", "question", "q", "you"),
    "assistant": ("assistant", "ai", "bot", "model", "answer", "a", "agent"),
}
_WORD = {word: role for role, words in SPEAKERS.items() for word in words}
#: `` ### User:``, ``<|user|>``, ``[user]``, ``**User:**`` or ``User:`` at the start of a line.
MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|<\||\[)?\s*(" + "|".join(sorted(_WORD, key=len, reverse=True)) + r")\s*(?:\|>|\]|:\s*\*\*|:|\*\*)\s?", re.IGNORECASE)
#: Bytes and rows of a partition on average, at most: what one task holds at once. Small tables are dealt over all tasks.
PART_BYTES, PART_ROWS, LEAST_ROWS = 32 << 20, 200_000, 500
#: Role, whether the line opens a turn, and whether the transcript leaves turns without a marker.
STATES = [(role, opens, bare) for bare in (0, 1) for role in range(len(ROLES)) for opens in (0, 1)]
#: Values of each feature of a line: marker, empty, length, end, and what is before the line.
FEATURES = (4, 2, 4, 4, 3)
#: What may be before a line: one with text, an empty one, or nothing.
TEXT, EMPTY, NOTHING = range(3)
#: Counted besides each feature value and transition, so that nothing is impossible.
PRIOR = 0.5
NEVER = 1e-9


def line_features(lines: list[str], before: int = NOTHING) -> np.ndarray:
    """The features of ``lines`` that follow each other. ``before``: what is before the first."""
    out = np.zeros((len(lines), len(FEATURES)), np.int64)
    for i, line in enumerate(lines):
        m = MARKER.match(line)
        last = line.rstrip()[-1:]
        out[i] = (
            ROLES.index(_WORD[m[1].lower()]) + 1 if m else 0, not line.strip(), min(len(line).bit_length() // 3, 3),
            0 if not last else 1 if last in ".!" else 2 if last in "?:" else 3, before,
        )
        before = TEXT if line.strip() else EMPTY
    return out


class Model:
    """Log probabilities from counts; ``counts``: {(kind, a, b): n} with kind ``start``, ``step`` or a feature's number."""

    def __init__(self, counts: dict[tuple[str, int, int], int]):
        n = len(STATES)
        start, step = np.full(n, PRIOR), np.full((n, n), PRIOR)
        emit = [np.full((n, size), PRIOR) for size in FEATURES]
        for (kind, a, b), times in counts.items():
            if kind == "start":
                start[a] += times
            elif kind == "step":
                step[a, b] += times
            else:
                emit[int(kind)][a, b] += times
        for a, (role, opens, bare) in enumerate(STATES):
            if not opens:  # a transcript begins with a turn
                start[a] = NEVER
            for b, (other, anew, kind) in enumerate(STATES):
                if bare != kind or not anew and role != other:  # a transcript is of one kind, and a turn goes on in its own role
                    step[a, b] = NEVER
        self.start = np.log(start / start.sum())
        self.step = np.log(step / step.sum(axis=1, keepdims=True))
        self.emit = [np.log(e / e.sum(axis=1, keepdims=True)) for e in emit]

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sum(e[:, features[:, f]].T for f, e in enumerate(self.emit))

    def within(self, features: np.ndarray) -> np.ndarray:
        """Best score from each state of a segment's first line, its own left out, to each state of its last line."""
        best = np.full((len(STATES), len(STATES)), -np.inf)
        np.fill_diagonal(best, 0)
        for e in self.scores(features)[1:]:
            best = (best[:, :, None] + self.step[None]).max(axis=1) + e
        return best

    def enter(self, first: np.ndarray, score: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Best score of each state of a line with the features ``first`` after ``score`` (None: it begins), and the state before."""
        emit = self.scores(first[None])[0]
        if score is None:
            return self.start + emit, None
        through = score[:, None] + self.step
        return through.max(axis=0) + emit, through.argmax(axis=0)

    def path(self, features: np.ndarray, before: int | None = None, last: int | None = None) -> np.ndarray:
        """The best states of a segment's lines, after the state ``before`` it and ending in ``last`` (None: nothing, the best)."""
        emit = self.scores(features)
        best = (self.start if before is None else self.step[before]) + emit[0]
        came = np.zeros((len(emit), len(STATES)), np.int8)
        for i, e in enumerate(emit[1:], 1):
            through = best[:, None] + self.step
            came[i] = through.argmax(axis=0)
            best = through.max(axis=0) + e
        states = np.zeros(len(emit), np.int64)
        states[-1] = best.argmax() if last is None else last
        for i in range(len(emit) - 1, 0, -1):
            states[i - 1] = came[i, states[i]]
        return states


# ---------------------------------------------------------------- lines in order


def ordered(transcripts: DataFrame) -> DataFrame:
    """``transcripts`` (conv_id, turn, raw, maybe role) in the order of transcripts, kept in partitions of bounded size.

    Pieces follow by turn number, null ones first, then by a hash of their text; the lines of a piece stay together,
    and those of equal rows follow each other. A null raw text is an empty line."""
    keep = [c for c in ("role",) if c in transcripts.columns]
    raw = F.coalesce("raw", F.lit(""))
    rows = transcripts.select("conv_id", "turn", *keep, raw.alias("raw"), F.xxhash64(raw).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("raw"))).first()
    tasks = 2 * transcripts.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // PART_ROWS), -(-int(size or 0) // PART_BYTES), min(tasks, -(-n // LEAST_ROWS)))
    key = ["conv_id", "turn", "_hash", "_row"]
    return settled(rows.repartitionByRange(parts, *key).sortWithinPartitions(*key).select("conv_id", *keep, "raw"))


def segments(batches) -> Iterator[tuple]:
    """The runs of pieces of one transcript in a partition: conv_id, the lines of each piece, and the roles of the pieces, if known."""

    def pieces():
        for batch in batches:
            roles = batch["role"].to_pylist() if "role" in batch.schema.names else [None] * batch.num_rows
            yield from zip(batch["conv_id"].to_pylist(), batch["raw"].to_pylist(), roles)

    for conv_id, run in groupby(pieces(), key=lambda p: p[0]):
        run = list(run)
        yield conv_id, [raw.split("\n") for _, raw, _ in run], [role for *_, role in run]


def at_ends(runs: Iterator[tuple]) -> Iterator[tuple]:
    """The first and the last segment of a partition: others can't go on in another one."""
    first = last = next(runs, None)
    if first is not None:
        yield first
    for last in runs:
        pass
    if last is not first:
        yield last


def flat(pieces: list[list[str]]) -> list[str]:
    return [line for piece in pieces for line in piece]


def fit(rows: DataFrame) -> Model:
    """The model from ``ordered`` rows with roles: counts of starts, steps and features, summed over all lines.

    Their number is that of the model's parameters, whatever the size of the table. Pieces of another role than
    ROLES are left out. Of a transcript that a partition boundary cuts, the one step across isn't counted."""

    def count(batches):
        n: Counter = Counter()
        cut = TaskContext.get().partitionId() > 0  # the first segment may go on from another partition
        for _, pieces, roles in segments(batches):
            known = [(p, ROLES.index(r)) for p, r in zip(pieces, roles) if r in ROLES]
            if not known:
                continue
            bare = int(any(not MARKER.match(p[0]) for p, _ in known))
            states = np.array([STATES.index((r, int(i == 0), bare)) for p, r in known for i in range(len(p))])
            if not cut:
                n["start", int(states[0]), 0] += 1
            n.update(("step", int(a), int(b)) for a, b in zip(states, states[1:]))
            features = line_features(flat([p for p, _ in known]), TEXT if cut else NOTHING)
            for f in range(len(FEATURES)):
                n.update((str(f), int(s), int(v)) for s, v in zip(states[int(cut) :], features[int(cut) :, f]))
            cut = False
        columns = list(zip(*((*k, v) for k, v in n.items()))) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["kind", "a", "b", "n"])

    counted = rows.select("conv_id", "raw", "role").mapInArrow(count, "kind string, a int, b int, n long")
    found = counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Model({(r["kind"], r["a"], r["b"]): r["n"] for r in found})


# ---------------------------------------------------------------- transcripts over several partitions


def cut_transcripts(rows: DataFrame, model: Model) -> dict:
    """Of the segments of transcripts that partition boundaries cut: (partition, conv_id) to what is before the segment,
    the state before it (None: it begins), the state of its last line, and whether the transcript goes on.

    A partition has two such segments at most, so two small rows of each come to the driver."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def ends(batches):
        part = TaskContext.get().partitionId()
        for conv_id, pieces, _ in at_ends(segments(batches)):
            lines = flat(pieces)
            features = line_features(lines, TEXT)
            yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "part": part, "first": features[0].tolist(), "ends_empty": not lines[-1].strip(), "best": model.within(features).tobytes()}], schema)

    columns = f"conv_id {kind}, part int, first array<int>, ends_empty boolean, best binary"
    schema = to_arrow_schema(_parse_datatype_string(columns))

    def chain(group: pa.Table) -> pa.Table:
        """Viterbi over the segments of one transcript."""
        runs = sorted(group.to_pylist(), key=lambda r: r["part"])
        out = {"part": [], "conv_id": [], "before": [], "state_before": [], "state_last": [], "goes_on": []}
        if len(runs) > 1:
            score, steps, before = None, [], NOTHING
            for r in runs:
                first = np.array(r["first"])
                first[-1] = before
                entry, came = model.enter(first, score)
                through = entry[:, None] + np.frombuffer(r["best"]).reshape(len(STATES), -1)
                steps.append((came, through.argmax(axis=0), before))
                score, before = through.max(axis=0), EMPTY if r["ends_empty"] else TEXT
            last = int(score.argmax())
            for r, (came, entered, before) in zip(reversed(runs), reversed(steps)):
                own = None if came is None else int(came[entered[last]])
                for name, value in (("part", r["part"]), ("conv_id", r["conv_id"]), ("before", before), ("state_before", own), ("state_last", last), ("goes_on", r is not runs[-1])):
                    out[name].append(value)
                last = own
        return pa.table([pa.array(out[f.name], f.type) for f in found], schema=found)

    made = f"part int, conv_id {kind}, before int, state_before int, state_last int, goes_on boolean"
    found = to_arrow_schema(_parse_datatype_string(made))
    chained = rows.select("conv_id", "raw").mapInArrow(ends, columns).groupBy("conv_id").applyInArrow(chain, made)
    return {(r["part"], r["conv_id"]): (r["before"], r["state_before"], r["state_last"], r["goes_on"]) for r in chained.collect()}


def pieces_of(model: Model, pieces: list[list[str]], cut: tuple | None) -> list[tuple[str, str]]:
    """Role and text of the turns of a segment, markers left out; the first goes on from before if ``cut`` says that something is there."""
    before, state_before, state_last, _ = cut or (NOTHING, None, None, False)
    lines = flat(pieces)
    out: list[tuple[str, list[str]]] = []
    for i, (line, state) in enumerate(zip(lines, model.path(line_features(lines, before), state_before, state_last))):
        role, opens, _ = STATES[state]
        if opens or i == 0:
            out.append((ROLES[role], []))
            if i == 0 and not opens and state_before is not None:
                out[-1] = (None, out[-1][1])
        out[-1][1].append(MARKER.sub("", line, count=1) if opens else line)
    return [(role, "\n".join(text)) for role, text in out]


def parse_ordered(rows: DataFrame, model: Model) -> DataFrame:
    """Turns of ``ordered`` rows: conv_id, turn (from 0), role, text without its marker, and the rendered turn."""
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, turn int, role string, text string"
    raw = rows.select("conv_id", "raw")
    cuts = cut_transcripts(raw, model)
    shared = spark.sparkContext.broadcast(cuts)

    def arrays(found: list[tuple]) -> list[pa.Array]:
        return [pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * len(kinds), kinds)]

    names, kinds = zip(*((f.name, f.type) for f in to_arrow_schema(_parse_datatype_string(schema + ", part int, opened int"))))

    def edges(batches):
        """Of the segments at boundaries: the turns that a boundary may cut, with the segment's number of turns."""
        part = TaskContext.get().partitionId()
        for conv_id, pieces, _ in at_ends(segments(batches)):
            cut = shared.value.get((part, conv_id))
            if cut:
                turns = pieces_of(model, pieces, cut)
                on, opened = turns[0][0] is None, sum(role is not None for role, _ in turns)
                found = [(conv_id, -1, None, turns[0][1], part, opened)] if on else []
                if cut[3] and turns[-1][0] is not None:
                    found.append((conv_id, opened - 1, *turns[-1], part, opened))
                found = found or [(conv_id, None, None, None, part, opened)]
                yield pa.RecordBatch.from_arrays(arrays(found), names)

    cut_turns = None
    offsets: dict = {}
    if cuts:
        cut_turns = settled(raw.mapInArrow(edges, schema + ", part int, opened int"))
        opened: Counter = Counter()
        for r in sorted(cut_turns.select("part", "conv_id", "opened").distinct().collect(), key=lambda r: r["part"]):
            offsets[r["part"], r["conv_id"]] = opened[r["conv_id"]]
            opened[r["conv_id"]] += r["opened"]
    started = spark.sparkContext.broadcast(offsets)

    def whole(batches):
        """All turns that no boundary cuts."""
        part = TaskContext.get().partitionId()
        found: list = []
        for conv_id, pieces, _ in segments(batches):
            cut = shared.value.get((part, conv_id))
            turns = pieces_of(model, pieces, cut)
            first = started.value.get((part, conv_id), 0)
            turns = turns[turns[0][0] is None :]
            turns = [(conv_id, first + i, role, text.strip("\n"), part, 0) for i, (role, text) in enumerate(turns)]
            found += turns[:-1] if cut and cut[3] else turns
            if len(found) >= 5_000:
                yield pa.RecordBatch.from_arrays(arrays(found), names)
                found = []
        yield pa.RecordBatch.from_arrays(arrays(found), names)

    turns = raw.mapInArrow(whole, schema + ", part int, opened int").select("conv_id", "turn", "role", "text")
    if cuts:
        begun = [(*k, n) for k, n in offsets.items()]
        before = F.broadcast(spark.createDataFrame(begun, f"_part int, _conv {kind}, _before int"))  # two rows a partition at most
        joined = cut_turns.where("turn is not null").join(before, (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv")))
        gathered = joined.groupBy("conv_id", (F.col("_before") + F.col("turn")).alias("turn")).agg(
            F.array_sort(F.collect_list(F.struct("part", "text"))).alias("_pieces"), F.max("role").alias("role"))  # one piece opens the turn and has its role
        text = F.trim(F.array_join(F.transform("_pieces", lambda x: x["text"]), "\n"), F.lit("\n"))
        turns = turns.unionByName(gathered.select("conv_id", "turn", "role", text.alias("text")))
    return turns.select("conv_id", "turn", "role", "text", render(F.col("role"), F.col("text")).alias("rendered"))


def render(role: Column, text: Column) -> Column:
    """A turn in the canonical form."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def parse_transcripts(transcripts: DataFrame, model: Model) -> DataFrame:
    """Turns of ``transcripts`` (conv_id, turn, raw): raw pieces in order, whose lines may open turns anywhere.

    A null raw text is an empty line. Rows of a null conv_id are one transcript; repeated rows are pieces as
    others, one after the other, and null turn numbers come first. Pieces of any length and transcripts of any
    number of pieces are parsed whole. Other columns are ignored; an empty table gives no rows."""
    return parse_ordered(ordered(transcripts.select("conv_id", "turn", "raw")), model)


#: How the transcripts of known conversations are written for training and tests, by the conversation's checksum:
#: templates of a turn's head; the last has a marker on every third turn only and parts the others by empty lines.
STYLES = ("{Role}: ", "### {Role}:\n", "<|{role}|>\n", "[{role}] ", "{short}: ", "sparse")


def as_transcript(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) as raw pieces with speaker markers: conv_id, turn, role, raw."""
    style = F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")), F.lit(len(STYLES)))
    role = F.coalesce("role", F.lit("user"))
    short = F.when(role == "user", "Q").when(role == "assistant", "A").otherwise("System")
    head = F.when(style == 0, F.concat(F.initcap(role), F.lit(": "))).when(style == 1, F.concat(F.lit("### "), F.initcap(role), F.lit(":\n")))
    head = head.when(style == 2, F.concat(F.lit("<|"), role, F.lit("|>\n"))).when(style == 3, F.concat(F.lit("["), role, F.lit("] ")))
    head = head.when(style == 4, F.concat(short, F.lit(": "))).otherwise(F.when(F.col("turn") % 3 == 0, F.concat(F.initcap(role), F.lit(": "))).otherwise(""))
    return conversations.select("conv_id", "turn", role.alias("role"), F.concat(head, F.coalesce("text", F.lit("")), F.when(style == 5, "\n").otherwise("")).alias("raw"))


def held_out(conv_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(conv_id.cast("string"), F.lit("")).cast("binary")), F.lit(30)) >= 24


def op9_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of all conversations, parsed by a model that has learnt from those not held out."""
    rows = ordered(as_transcript(table(spark, sf_dir, "conversations")))
    turns = parse_ordered(rows, fit(rows.where(~held_out(F.col("conv_id")))))
    return turns.select("conv_id", "turn", "role", "text", "rendered", held_out(F.col("conv_id")).alias("held_out"))
