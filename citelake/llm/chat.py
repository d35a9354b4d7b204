"""Chat formatting: roles by a hidden Markov model, then one canonical rendering of turns.

States are the roles, each as the first or a later line of a turn. A line shows a speaker marker (a
label such as "User:" at its start), whether a turn is known to begin there, and features: its length, a
question mark, list or code marks. Start and transition probabilities and feature frequencies are
counted on at most SAMPLE turns with known roles, of the conversations with the smallest hashes of
their ids, and smoothed; a label is all but sure. Viterbi's path over all lines of a conversation gives
the role of each turn. A turn is rendered as <|role|>, its text and <|end|>.

format_conversations takes a table of turns: each row is known to begin a turn, whose lines go on with
it. Their roles are hidden from the model unless `given` names them as known, and recovered from
markers, features and the order of turns; the query hides all roles and returns the recovered one beside
whether the table agrees. parse_transcripts takes whole transcripts and finds the turns too.

The result has a row for each turn, so nothing of a conversation's length is gathered in one row. A
conversation is decoded in parts of PART consecutive turn numbers: each part gives a matrix of best
scores from state to state, the matrices of a conversation are chained to find the states at the limits
of its parts, and then each part is decoded between its limits, which gives the path of the whole.

Defined cases: a null text counts as empty; rows of equal turn number are ordered by text, then
role; null turn numbers come first, ordered likewise; a null conv_id is one conversation; unknown
roles count as null, and agree with nothing; repeated rows are repeated turns; an empty table gives an empty
table; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.llm.common import map_texts, read_table, slices

ROLES = ("system", "user", "assistant")
#: Fixed names of roles in common transcript formats.
NAMES = {
    "system": 0, "instruction": 0, "instructions": 0, "sys": 0,
    "user": 1, "human": 1, "prompter": 1, "question": 1, "q": 1, "customer": 1, "you": 1,
    "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "model": 2, "answer": 2, "a": 2, "agent": 2, "chatgpt": 2, "response": 2,
}
PART = 4096
NO_TURN = -(1 << 62)  # the part of null turn numbers, before all others
SAMPLE = 20_000
GIVEN, LABELLED = 1e-6, 1e-3  # chance of a wrong role beside a turn, and of a misleading label in a line
_LABEL = re.compile(r"\s*(?:<\|(?:im_start\|>)?|#{1,4}\s*|\*\*|\[)?([A-Za-z]{1,12})(?:\|>|\*\*|\])?\s*(:|\n|$)(?:\*\*)?\s*")
_END = re.compile(r"\s*<\|(?:im_)?end\|>\s*\Z")
BINS = 24


def bin_of(text: str) -> int:
    """The feature bin of a line or turn: length class x question x list or code marks."""
    size = len(text)
    length = 0 if size < 20 else 1 if size < 60 else 2 if size < 160 else 3 if size < 400 else 4 if size < 1000 else 5
    marked = "```" in text or bool(re.match(r"\s*(?:[-*] |\d+[.)] )", text))
    return length * 4 + 2 * ("?" in text) + marked


def label_of(line: str) -> tuple[int, str] | None:
    """(role, rest of the line) of a line that begins with a speaker label."""
    m = _LABEL.match(line)
    if m and (m[2] == ":" or line.lstrip()[:1] in "<#*[") and m[1].lower() in NAMES:
        return NAMES[m[1].lower()], line[m.end() :]
    return None


@dataclass
class Hmm:
    start: np.ndarray  # log, by role
    follow: np.ndarray  # log, role to role
    bins: np.ndarray  # log, role x BINS, of whole turns
    lines: np.ndarray  # the same of single lines
    more: float = 0.6  # chance that a turn goes on in the next line

    @classmethod
    def counted(cls, turns: Iterable[tuple[object, int | None, int, list[int]]]) -> Hmm:
        """From (conversation, role, bin of the turn, lines by bin) in order."""
        start, follow, bins, lines = np.full(3, 1.0), np.full((3, 3), 1.0), np.full((3, BINS), 1.0), np.full((3, BINS), 1.0)
        ends, later = 4.0, 6.0
        before: tuple | None = None
        for conversation, known, whole, parts in turns:
            if known is not None:
                bins[known, whole] += 1
                lines[known] += parts
                ends, later = ends + 1, later + sum(parts) - 1
                if before is None or before[0] != conversation:
                    start[known] += 1
                elif before[1] is not None:
                    follow[before[1], known] += 1
            before = conversation, known
        smooth = lambda x: np.log(0.97 * x / x.sum(-1, keepdims=True) + 0.03 / x.shape[-1])
        return cls(smooth(start), smooth(follow), smooth(bins), smooth(lines), later / (ends + later))

    def emissions(self, lines: Sequence[str], given: Sequence[int | None], begins: Sequence[bool | None]) -> np.ndarray:
        """Log likelihoods (lines x 6): states 0-2 begin a turn of a role, 3-5 go on with it."""
        out = np.zeros((len(lines), 6))
        labels = [None if begin is False else label_of(x) for x, begin in zip(lines, begins, strict=True)]
        # where turns are labelled, one without a label is as rare as a misleading label
        unlabelled = LABELLED if any(x and b is None for x, b in zip(labels, begins, strict=True)) else 0.05
        for i, (line, role, begin, label) in enumerate(zip(lines, given, begins, labels, strict=True)):
            out[i] = np.tile(self.lines[:, bin_of(line)], 2)
            for sure, chance in ((role, GIVEN), (label[0] if label else None, LABELLED)):
                if sure is not None:
                    shown = np.full(3, np.log(chance))
                    shown[sure] = np.log(1 - 2 * chance)
                    out[i, :3] += shown
                    out[i, 3:] += np.log(chance) if label else shown
            if label is None and begin is None:
                out[i, :3] += np.log(unlabelled)  # an unlabelled line seldom begins a turn
            if begin is not None:
                out[i, 3 if begin else 0 : 6 if begin else 3] = -np.inf
        return out

    def turn_emissions(self, texts: Sequence[str], given: Sequence[int | None]) -> np.ndarray:
        """Log likelihoods (turns x 3) of whole turns: their lines' together, by the only path that begins at the first."""
        out = np.zeros((len(texts), 3))
        for i, (text, role) in enumerate(zip(texts, given, strict=True)):
            lines = text.split("\n")
            shown = self.emissions(lines, [role] + [None] * (len(lines) - 1), [True] + [False] * (len(lines) - 1))
            out[i] = shown[0, :3] + shown[1:, 3:].sum(0) + (len(lines) - 1) * np.log(self.more) + self.bins[:, bin_of(text)]
        return out

    def steps(self) -> np.ndarray:
        """Log transitions between the six states."""
        go = np.full((6, 6), -np.inf)
        for half in (0, 3):
            go[half : half + 3, :3] = self.follow + np.log(1 - self.more)
            go[half + np.arange(3), 3 + np.arange(3)] = np.log(self.more)
        return go

    def begin(self) -> np.ndarray:
        return np.concatenate([self.start, np.full(3, -np.inf)])

    def _chain(self, states: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and transitions over lines (six states) or over whole turns (three)."""
        return (self.begin(), self.steps()) if states == 6 else (self.start, self.follow)

    def matrix(self, e: np.ndarray) -> np.ndarray:
        """Best score of a part from each state at its start to each at its end; states x states, max-plus."""
        go = self._chain(e.shape[1])[1]
        m = np.where(np.eye(e.shape[1]) > 0, e[0][None], -np.inf)
        for row in e[1:]:
            m = (m[:, :, None] + go[None]).max(1) + row[None]
        return m

    def limits(self, matrices: list[np.ndarray]) -> list[tuple[int, int]]:
        """The states at each part's start and end on the best path through all parts."""
        entry, go = self._chain(len(matrices[0]))
        entries, scores = [], []
        for m in matrices:
            entries.append(entry)
            scores.append((entry[:, None] + m).max(0))
            entry = (scores[-1][:, None] + go).max(0)
        out, last = [], int(scores[-1].argmax())
        for i in range(len(matrices) - 1, -1, -1):
            first = int((entries[i] + matrices[i][:, last]).argmax())
            out.append((first, last))
            if i:
                last = int((scores[i - 1] + go[:, first]).argmax())
        return out[::-1]

    def path(self, e: np.ndarray, entry: int | None = None, last: int | None = None) -> list[int]:
        """Viterbi's states, between the given states at the start and the end, if any."""
        begin, go = self._chain(e.shape[1])
        score = (begin if entry is None else np.where(np.arange(e.shape[1]) == entry, 0.0, -np.inf)) + e[0]
        back = []
        for row in e[1:]:
            all_ = score[:, None] + go
            back.append(all_.argmax(0))
            score = all_.max(0) + row
        at = int(score.argmax()) if last is None else last
        out = [at]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def parse_transcript(text: str | None, model: Hmm) -> list[tuple[str, str]]:
    """(role, text) of the turns of a plain transcript; labels that begin turns are taken off."""
    lines = (text or "").split("\n")
    if not (text or "").strip():
        return []
    states = model.path(model.emissions(lines, [None] * len(lines), [None] * len(lines)))
    turns: list[tuple[int, list[str]]] = []
    for line, state in zip(lines, states, strict=True):
        label = label_of(line)
        if state < 3:
            turns.append((state, [label[1] if label and label[0] == state else line]))
        else:
            turns[-1][1].append(line)
    return [(ROLES[r], _END.sub("", "\n".join(x)).strip(" \t\r\n")) for r, x in turns]


def parse_transcripts(texts: DataFrame, model: Hmm, id_column: str = "conv_id", text_column: str = "text") -> DataFrame:
    """id_column and turns, the roles and texts that each whole transcript shows; a role column is not read."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def turns(found: list) -> dict[str, list]:
        return {"turns": [[{"role": r, "text": x} for r, x in parse_transcript(t, shared.value)] for t in found]}

    return map_texts(texts, id_column, text_column, "turns array<struct<role:string,text:string>>", lambda: turns)


def rendered(role: str, text: str | None) -> str:
    return f"<|{role}|>\n{(text or '').strip(' \t\r\n').replace('<|', '< |')}\n<|end|>\n"


def count_model(turns: DataFrame, sample: int = SAMPLE) -> Hmm:
    """The model counted on at most `sample` turns; tasks make their features, so no text reaches the driver."""
    text, name = F.coalesce(F.col("text").cast("string"), F.lit("")), F.lower(F.col("role").cast("string"))
    keys = turns.select(F.xxhash64("conv_id").alias("h"), "conv_id", "turn", name.alias("name"), text.alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            wholes, lines = [], []
            for x in batch.column(4).to_pylist():
                wholes.append(bin_of(x))
                lines.append(np.bincount([bin_of(line) for line in x.split("\n")], minlength=BINS).tolist())
            roles = [NAMES.get(r or "") for r in batch.column(3).to_pylist()]
            made = [pa.array(roles, pa.int32()), pa.array(wholes, pa.int32()), pa.array(lines, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(5), *made], names=["h", "conv_id", "turn", "tie", "known", "whole", "lines"])

    kinds = [turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    made = keys.withColumn("tie", F.xxhash64("text", "name")).mapInArrow(describe, f"h long, conv_id {kinds[0]}, turn {kinds[1]}, tie long, known int, whole int, lines array<int>")
    rows = made.orderBy("h", "conv_id", "turn", "tie").limit(sample).collect()
    return Hmm.counted((r["h"], r["known"], r["whole"], r["lines"]) for r in rows)


def _part_emissions(model: Hmm, turns: list[dict], given: bool) -> np.ndarray:
    known = [NAMES.get((t["role"] or "").lower()) if given else None for t in turns]
    return model.turn_emissions([t["text"] or "" for t in turns], known)


def format_conversations(turns: DataFrame, model: Hmm | None = None, given: bool = False, part: int = PART) -> DataFrame:
    """conv_id, turn, role (recovered), agrees (with the table's role) and rendered, a row for each turn.

    given: whether the table's roles are known to the model, so that only missing ones are recovered.
    """
    model = model or count_model(turns)
    number = F.coalesce(F.floor(F.col("turn") / part).cast("long"), F.lit(NO_TURN).cast("long"))
    item = F.struct(F.col("turn").cast("long").alias("turn"), F.col("text").cast("string").alias("text"), F.col("role").cast("string").alias("role"))
    parts = turns.select("conv_id", number.alias("part"), item.alias("item")).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("item")).alias("items"))
    kind = parts.schema["conv_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.matrix(_part_emissions(model, x, given)).ravel().tolist() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["conv_id", "part", "m"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, matrices in enumerate(batch.column(1).to_pylist()):
                found = model.limits([np.array(m["m"]).reshape(3, 3) for m in matrices])
                rows += [i] * len(found)
                out += [(m["part"], *x) for m, x in zip(matrices, found, strict=True)]
            columns = [pa.array([o[k] for o in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=["conv_id", "part", "entry", "last"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                batch = whole.slice(at, 1)
                items = batch.column(2)[0].as_py()
                ends = [batch.column(k)[0].as_py() for k in (3, 4)] if batch.num_columns > 3 else [None, None]
                names = [ROLES[s] for s in model.path(_part_emissions(model, items, given), *ends)]
                agrees = [NAMES.get((t["role"] or "").lower(), -1) == ROLES.index(r) for t, r in zip(items, names, strict=True)]
                texts = [rendered(r, t["text"]) for r, t in zip(names, items, strict=True)]
                own = batch.column(0).take(pa.array([0] * len(items)))
                yield pa.RecordBatch.from_arrays([own, pa.array([t["turn"] for t in items], pa.int64()), pa.array(names, pa.string()), pa.array(agrees), pa.array(texts, pa.string())], names=["conv_id", "turn", "role", "agrees", "rendered"])

    schema = f"conv_id {kind}, turn long, role string, agrees boolean, rendered string"
    # conversations of several parts are few; the others need no chaining
    spread = turns.groupBy("conv_id").agg(F.min(number).alias("a"), F.max(number).alias("b")).where("a < b").select(F.col("conv_id").alias("_conv"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    whole = parts.join(spread, same, "left_anti").mapInArrow(decode, schema)
    long_ = parts.join(spread, same, "left_semi")
    scored = long_.mapInArrow(score, f"conv_id {kind}, part long, m array<double>")
    chained = scored.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "m"))).alias("ms")).mapInArrow(chain, f"conv_id {kind}, part long, entry long, last long")
    chained = chained.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "entry", "last")
    joined = long_.join(chained, same & (F.col("part") == F.col("_part"))).select("conv_id", "part", "items", "entry", "last")
    return whole.unionByName(joined.mapInArrow(decode, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(read_table(spark, sf_dir, "conversations"))
