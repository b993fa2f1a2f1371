"""Chat transcripts: roles recovered by a hidden Markov model, turns rendered canonically.

States are (role, first line of a turn or a later one).  A line is observed through its
speaker marker, if any, and a few categorical features.  Start, transition and emission
probabilities are counted, with smoothing, over labelled turns, so training is one grouped
count with a bounded result; Viterbi recovers the states of each transcript.

Turns are sorted over all tasks by conversation and turn, so a long conversation lies in
several tasks, each holding a piece.  A piece's best scores from every state to every state
are one small matrix; the matrices of the pieces (two at most for each task) give the states
at the edges, and each piece is then decoded with its edges fixed: the path has the score of
the best one for the conversation as a whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import crc_bucket, cut_lineage

ROLES = ("system", "user", "assistant")
#: Ways to mark a speaker, one list for each style of transcript.
STYLES = (
    {"system": "System:", "user": "User:", "assistant": "Assistant:"},
    {"system": "### System", "user": "### Instruction", "assistant": "### Response"},
    {"system": "<<SYS>>", "user": "Human:", "assistant": "AI:"},
    {"system": "[system]", "user": "Q:", "assistant": "A:"},
)
MARK = re.compile(r"^\s*(?:#{1,4}\s*(\w{1,16})|<<?(\w{1,16})>>?|\[(\w{1,16})\]|\**(\w{1,16})\**\s*:)\s*", re.UNICODE)
#: Turns of one batch of results.
BATCH_TURNS = 2_000


def observe(line: str, blank_before: bool) -> list[str]:
    """Categorical features of a line."""
    found = MARK.match(line)
    mark = next((g for g in found.groups() if g), "").lower() if found else "none"
    rest = line[found.end():] if found else line
    return [f"mark={mark}", f"size={min(12, len(rest) // 40)}", f"blank={blank_before}", f"ask={rest.rstrip().endswith('?')}"]


def lines_of(transcript: str) -> list[tuple[str, int]]:
    """Non-blank lines, each with the number of blank ones before it; the first counts as after one."""
    out, blank = [], 1
    for line in transcript.split("\n"):
        if line.strip():
            out.append((line, blank))
            blank = 0
        else:
            blank += 1
    return out


def observed(lines: list[tuple[str, int]]) -> list[list[str]]:
    return [observe(line, blank > 0) for line, blank in lines]


class Model:
    """Log probabilities of the hidden Markov model from counts of (kind, state, value)."""

    def __init__(self, counts: dict[tuple[str, str, str], int], roles: tuple[str, ...] = ROLES):
        self.roles = roles
        self.states = [f"{r}/{p}" for r in roles for p in ("first", "later")]
        self._total: dict[tuple[str, str], Counter] = defaultdict(Counter)
        for (kind, state, value), n in counts.items():
            self._total[kind, state][value] += n
        n = len(self.states)
        self.start = [self._log("start", "", s, n) for s in self.states]
        self.step = [[self._log("next", a, b, n) for b in self.states] for a in self.states]
        self._emit: dict[tuple[str, str], float] = {}

    def _log(self, kind: str, state: str, value: str, choices: int) -> float:
        own = self._total[kind, state]
        return math.log((own[value] + 0.5) / (own.total() + 0.5 * choices))

    def emission(self, state: str, features: list[str]) -> float:
        out = 0.0
        for f in features:
            if (state, f) not in self._emit:
                self._emit[state, f] = self._log(f.partition("=")[0], state, f, 16)
            out += self._emit[state, f]
        return out

    def viterbi(self, observed: list[list[str]], before: int | None = None, last: int | None = None) -> list[str]:
        """The likeliest states; ties go to the state listed first.

        before: number of the state ahead of the first line (None: a transcript begins); last:
        number of the last line's state (None: the best).
        """
        if not observed:
            return []
        k = range(len(self.states))
        entry = self.start if before is None else self.step[before]
        best = [entry[s] + self.emission(self.states[s], observed[0]) for s in k]
        back = []
        for features in observed[1:]:
            origin = [max(k, key=lambda a, s=s: best[a] + self.step[a][s]) for s in k]
            best = [best[origin[s]] + self.step[origin[s]][s] + self.emission(self.states[s], features) for s in k]
            back.append(origin)
        state = max(k, key=best.__getitem__) if last is None else last
        path = [state]
        for origin in reversed(back):
            path.append(state := origin[state])
        return [self.states[s] for s in reversed(path)]

    def through(self, observed: list[list[str]]) -> np.ndarray:
        """Best scores of a piece: row a, column b from state a ahead of it to b at its end; the last row from a start."""
        step = np.array(self.step)
        best = np.vstack([step, self.start])
        for k, features in enumerate(observed):
            own = np.array([self.emission(s, features) for s in self.states])
            best = (best if k == 0 else (best[:, :, None] + step[None]).max(axis=1)) + own
        return best

    def turns(self, lines: list[tuple[str, int]], states: list[str]) -> list[tuple[str, str]]:
        """(role, text) from lines and their states: a new turn at each first line, markers taken off.

        Blank lines inside a turn stay; a text has no white space at its ends.
        """
        out: list[tuple[str, list[str]]] = []
        for (line, blank), state in zip(lines, states, strict=True):
            role, place = state.rsplit("/", 1)
            if place == "first" or not out or out[-1][0] != role:
                found = MARK.match(line)
                out.append((role, [line[found.end():] if found else line]))
            else:
                out[-1][1].extend([*[""] * blank, line])
        return [(role, "\n".join(x).strip()) for role, x in out]

    def parse(self, transcript: str) -> list[tuple[str, str]]:
        """Turns (role, text) of a transcript; none if it is blank."""
        lines = lines_of(transcript)
        return self.turns(lines, self.viterbi(observed(lines)))


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def write_transcript(turns: list[tuple[str, str]], style: int, unmarked: list[bool]) -> str:
    """A transcript with a marker before each turn but the unmarked ones, after a blank line."""
    marks = STYLES[style % len(STYLES)]
    out = []
    for (role, text), bare in zip(turns, unmarked, strict=True):
        mark = "" if bare else marks.get(role, f"{role}:")
        out.append(f"{mark}\n{text}" if mark[:1] in "#<[" and mark else f"{mark} {text}".strip())
    return "\n\n".join(out)


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, held_out and part: turns in order, written to the shared checkpoint folder.

    A part is a task's share of the sorted rows.  Rows of one conv_id and turn are ordered by role, hash of
    the text and text; a null turn comes first; null roles or texts are empty strings.  held_out: crc32
    of conv_id as text modulo 4 is 2.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                                (crc_bucket("conv_id", 4) == 2).alias("held_out"))
    # The last key only spreads rows that are the same in all others.
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("salt", F.monotonically_increasing_id())
    keys = ("conv_id", "turn", "role", "hash")
    spread = rows.repartitionByRange(*keys, "salt").sortWithinPartitions(*keys, "text")
    return cut_lineage(spread.select("conv_id", "turn", "role", "text", "held_out", F.spark_partition_id().alias("part")))


class Piece:
    """The turns of one conversation in one part."""

    def __init__(self, part: int, conv_id, held_out: bool, nth: int):
        self.part, self.conv_id, self.held_out, self.nth, self.ends_part = part, conv_id, held_out, nth, False
        self.turns: list[tuple[int | None, str, str]] = []

    def name(self) -> str:
        return "" if self.conv_id is None else f"={self.conv_id}"

    def at_edge(self) -> bool:
        return self.nth == 0 or self.ends_part

    def written(self) -> list[str]:
        """Each turn as a transcript has it: style, and the turns without a marker, follow from the ids."""
        draw = lambda *x: zlib.crc32(":".join(map(str, x)).encode())
        style = draw("style", self.conv_id)
        return [write_transcript([(role, text)], style, [draw(self.conv_id, turn, len(text)) % 4 == 0]) for turn, role, text in self.turns]


def _pieces(it: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    now = None
    for batch in it:
        for conv_id, turn, role, text, held_out, part in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if now is None or conv_id != now.conv_id or part != now.part:
                if now is not None:
                    now.ends_part = part != now.part
                    yield now
                now = Piece(part, conv_id, held_out, now.nth + 1 if now is not None and part == now.part else 0)
            now.turns.append((turn, role, text))
    if now is not None:
        now.ends_part = True
        yield now


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def counted(turns: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """(kind, state, value, n) over the turns of known roles, from sorted_turns.

    Pieces at the edge of a part give their first and last state too, as kind `edge`, state
    "part:nth:ends" and value "first>last"; what joins two pieces is counted by fit.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for piece in _pieces(it):
            states, seen = [], []
            for (_, role, _), text in zip(piece.turns, piece.written(), strict=True):
                if role in roles:
                    lines = lines_of(text)
                    states += [f"{role}/{'later' if k else 'first'}" for k in range(len(lines))]
                    seen += observed(lines)
            for state, features in zip(states, seen, strict=True):
                found.update((f.partition("=")[0], state, f) for f in features)
            found.update(("next", a, b) for a, b in zip(states, states[1:], strict=False))
            if piece.at_edge():
                found["edge", f"{piece.part}:{piece.nth}:{int(piece.ends_part)}:{piece.name()}", f"{states[0]}>{states[-1]}" if states else ""] += 1
            elif states:
                found["start", "", states[0]] += 1
        kinds = [("kind", pa.string()), ("state", pa.string()), ("value", pa.string()), ("n", pa.int64())]
        yield _batch([(*key, n) for key, n in found.items()], kinds)

    rows = turns.select("conv_id", "turn", "role", "text", "held_out", "part").mapInArrow(batches, "kind string, state string, value string, n bigint")
    return rows.groupBy("kind", "state", "value").agg(F.sum("n").alias("n"))


def _joined(edges: list[tuple[str, str]]) -> list[tuple[int, int, bool, str, str]]:
    """Edge rows (state, value) of counted, parsed and in order."""
    out = []
    for state, value in edges:
        part, nth, ends, conv = state.split(":", 3)
        out.append((int(part), int(nth), ends == "1", conv, value))
    return sorted(out)


def fit(turns: DataFrame, most_marks: int = 2_000) -> Model:
    """The model over sorted turns, of all their roles; ROLES where there are none.

    Of marker values the most_marks most frequent are kept, so the result is bounded; the other markers
    count as one value in each state, so totals are exact; no other kind of count is cut.  The driver
    sees two rows for each part besides.
    """
    found = turns.where("role <> ''").groupBy("role").count().collect()
    roles = tuple(sorted(r["role"] for r in found)) or ROLES
    rows = cut_lineage(counted(turns, roles))
    marks = rows.where("kind = 'mark'")
    most = marks.groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(most_marks).select("value", F.lit(True).alias("kept"))
    named = marks.join(F.broadcast(most), "value", "left").withColumn("value", F.when(F.col("kept"), F.col("value")).otherwise("mark="))  # no line has an empty marker
    named = named.groupBy("kind", "state", "value").agg(F.sum("n").alias("n"))
    counts: Counter = Counter()
    edges = []
    for r in rows.where("kind <> 'mark'").unionByName(named).collect():
        if r["kind"] == "edge":
            edges.append((r["state"], r["value"]))
        else:
            counts[r["kind"], r["state"], r["value"]] += r["n"]
    before: tuple[str, str] | None = None  # the conversation that reaches a part's end, and its last state
    for _, nth, ends, conv, value in _joined(edges):
        first, _, last = value.partition(">")
        going_on = nth == 0 and before is not None and before[0] == conv
        if first:
            counts[("next", before[1], first) if going_on and before[1] else ("start", "", first)] += 1
        before = (conv, last or (before[1] if going_on else "")) if ends else None
    return Model(dict(counts), roles)


def _edge_states(turns: DataFrame, model: Model) -> dict[int, dict[str, tuple[int | None, int | None]]]:
    """part -> piece ("first" or "last" of the part) -> the states before and at the end of a piece of a divided conversation.

    Each part gives the matrices of its first and last piece; the driver joins those of one
    conversation, from left to right for the scores and back for the states.
    """
    shared = turns.sparkSession.sparkContext.broadcast(model)
    kinds = [("part", pa.int32()), ("nth", pa.int64()), ("ends", pa.bool_()), ("conv", pa.string()), ("scores", pa.list_(pa.float64()))]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(it):
            if piece.at_edge():
                seen = [x for text in piece.written() for x in observed(lines_of(text))]
                scores = shared.value.through(seen).ravel().tolist() if seen else None
                yield _batch([(piece.part, piece.nth, piece.ends_part, piece.name(), scores)], kinds)

    edges = sorted(turns.mapInArrow(batches, "part int, nth bigint, ends boolean, conv string, scores array<double>").collect(), key=lambda r: (r["part"], r["nth"]))
    groups: list[list] = []
    for r in edges:
        divided = groups and r["nth"] == 0 and groups[-1][-1]["ends"] and groups[-1][-1]["conv"] == r["conv"]
        groups[-1].append(r) if divided else groups.append([r])
    out: dict[int, dict[str, tuple[int | None, int | None]]] = defaultdict(dict)
    n = len(model.states)
    for group in groups:
        pieces = [(r, np.array(r["scores"]).reshape(n + 1, n)) for r in group if r["scores"] is not None]
        if len(group) < 2 or not pieces:
            continue
        best = [pieces[0][1][n]]
        for _, scores in pieces[1:]:
            best.append((best[-1][:, None] + scores[:n]).max(axis=0))
        state = int(best[-1].argmax())
        for k in range(len(pieces) - 1, -1, -1):
            r, scores = pieces[k]
            before = int((best[k - 1] + scores[:n, state]).argmax()) if k else None
            out[r["part"]]["first" if r["nth"] == 0 else "last"] = (before, state)
            state = before
    return out


def parse_transcripts(rows: DataFrame, model: Model, text_col: str = "transcript") -> DataFrame:
    """rows with `roles_found` (comma-joined), `n_turns` and the canonical `rendered` text added.

    A null or blank transcript has no turn and an empty rendering.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<roles_found:string,n_turns:bigint,rendered:string>")
    def parsed(texts):
        import pandas as pd

        found = [shared.value.parse(t or "") for t in texts]
        return pd.DataFrame({"roles_found": [",".join(r for r, _ in x) for x in found], "n_turns": [len(x) for x in found], "rendered": [render(x) for x in found]})

    return rows.withColumn("__parsed", parsed(F.col(text_col))).select(*rows.columns, "__parsed.*")


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per turn that the model recovers, beside the turn that was written.

    conv_id, position (orders the turns of a conversation), held_out, role, text, rendered (the canonical
    form), goes_on (the text continues the turn before it, in the piece of another task), role_true,
    exact (role and text are those written).  The transcript is written from the turns in one of four
    styles, a quarter of the turns without a marker; roles are not given to the parser.  Where fewer turns
    are found than written, rows without role and text stand for the others.  An empty turn without a
    marker leaves no trace.  Roles that the model did not learn come out as the likeliest learned one.
    Repeated rows are turns of their own, a null conv_id is a conversation, other columns are ignored and
    an empty table gives no rows.
    """
    turns = sorted_turns(conversations)
    model = fit(turns.where("not held_out"))
    edges = _edge_states(turns, model)
    shared = conversations.sparkSession.sparkContext.broadcast((model, dict(edges)))
    kind = conversations.schema["conv_id"].dataType
    names = [("position", pa.int64()), ("held_out", pa.bool_()), ("role", pa.string()), ("text", pa.string()), ("rendered", pa.string()), ("goes_on", pa.bool_()), ("role_true", pa.string()), ("exact", pa.bool_())]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value
        schema = [("conv_id", pa.string() if kind.simpleString() == "string" else pa.int64()), *names]
        rows: list[tuple] = []
        at = part = 0
        for piece in _pieces(it):
            at, part = (at if piece.part == part else 0), piece.part
            before, last = known.get(part, {}).get("first" if piece.nth == 0 else "last" if piece.ends_part else "", (None, None))
            lines = [x for text in piece.written() for x in lines_of(text)]
            states = own.viterbi(observed(lines), before, last)
            found = own.turns(lines, states)
            goes_on = bool(states) and before is not None and states[0].endswith("/later") and own.states[before].rsplit("/", 1)[0] == found[0][0]
            for k in range(max(len(found), len(piece.turns))):
                role, text = found[k] if k < len(found) else (None, None)
                _, true_role, true_text = piece.turns[k] if k < len(piece.turns) else (None, None, None)
                rows.append((piece.conv_id, part << 33 | at, piece.held_out, role, text, render([found[k]]) if k < len(found) else None, goes_on and k == 0, true_role, (role, text) == (true_role, true_text)))
                at += 1
            if len(rows) >= BATCH_TURNS:
                yield _batch(rows, schema)
                rows = []
        yield _batch(rows, schema)

    return turns.mapInArrow(batches, f"conv_id {kind.simpleString() if kind.simpleString() == 'string' else 'bigint'}, position bigint, held_out boolean, role string, text string, rendered string, goes_on boolean, role_true string, exact boolean")


def conversation_report(turns: DataFrame) -> DataFrame:
    """One row per conversation of format_chats.

    n_turns (written), n_found, roles_right, exact (all turns are), rendered_digest (the sum of the 64-bit
    hashes of the canonical turns).  Sums and minima only, so a long conversation is merged before the shuffle.
    """
    return turns.groupBy("conv_id", "held_out").agg(
        F.count("role_true").alias("n_turns"), F.count_if(F.col("role").isNotNull() & ~F.col("goes_on")).alias("n_found"),
        F.count_if(F.col("role") == F.col("role_true")).alias("roles_right"), F.min("exact").alias("exact"),
        F.coalesce(F.sum(F.xxhash64("rendered").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("rendered_digest"))


def op9_chat(spark, sf_dir):
    return conversation_report(format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
