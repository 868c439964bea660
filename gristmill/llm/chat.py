"""Chat formatting: roles of a raw transcript's lines by a hidden Markov model, then canonical turns.

A state is a role and whether the line begins a turn or goes on with it. A line is seen as a few categories:
its speaker marker, length, end, first character, whether it follows a blank line or stands first. Spark counts
how often each state has each category, follows each state, or begins a transcript, over all labelled lines;
the counts are a few hundred rows, whatever the corpus holds. Viterbi's algorithm finds the likeliest states of
each transcript; lines of a turn are joined, markers dropped, and each turn rendered in one form.

A transcript that is a row is parsed by itself, so nothing is shuffled to parse. A dialogue kept as rows is dealt by
range of (conversation, turn) and cut into parts of bounded size; nearly all dialogues are one part. Of a longer one,
each part gives a matrix: the best score of its lines from each state before it to each state at its end. Two streams
over the matrices, forward and back, find the states between the parts on the best path of the whole dialogue; with
these the parts are parsed apart, turns are numbered through, and a turn that crosses a cut is joined again. So
neither a dialogue without end nor many rows of one turn meet in one task's memory.

Defined results: a null or blank transcript gives no turns; blank lines belong to the turn they stand in; a null id is
kept, and a row without conversation or turn is a dialogue of its own; rows of one conversation and turn follow each
other, ordered by a hash; rows repeated are parsed each; without labelled lines all states are equally likely but for
markers; an empty table gives no rows; columns besides those named are not read, and a key that is called like a
column of the result is returned as key_<name>; a very long text is parsed whole, by one task.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship_package
from .blocks import batchwise
from .shared import Workspace, few, partitions

ROLES = ("system", "user", "assistant")
#: Rows, and characters, at which a part of a dialogue ends.
PART_ROWS, PART_CHARS = 256, 1 << 20
#: Names by which speakers are marked, and whose they usually are.
SPEAKERS = {"system": 0, "note": 0, "context": 0, "user": 1, "human": 1, "q": 1, "question": 1, "instruction": 1, "prompt": 1, "customer": 1, "assistant": 2, "ai": 2, "bot": 2, "a": 2, "answer": 2, "response": 2, "gpt": 2, "agent": 2}
MARKER = re.compile(rf"^\s*(?:[#*\[<>|=-]{{0,4}}\s*)({'|'.join(sorted(SPEAKERS, key=len, reverse=True))})\s*(?:[:\]>|*#=-]{{1,4}})\s*", re.IGNORECASE)
N_STATES = 2 * len(ROLES)
#: Categories of each kind of feature.
KINDS = (2 + len(SPEAKERS), 14, 5, 5, 2, 2)
NAMES = {s: k + 1 for k, s in enumerate(SPEAKERS)}


def line_features(lines: list[str], blank: bool = False, first: bool = True) -> np.ndarray:
    """A row of categories for each line. blank: whether a blank line stands before them; first: whether a transcript begins with them."""
    out = np.zeros((len(lines), len(KINDS)), np.int64)
    for k, line in enumerate(lines):
        m = MARKER.match(line)
        body = line[m.end() :] if m else line
        end, lead = body.rstrip()[-1:], body.lstrip()[:1]
        out[k] = (
            NAMES[m[1].lower()] if m else 0,
            min(len(body).bit_length(), 13),
            0 if not end else 1 if end == "?" else 2 if end in ".!" else 3 if end == ":" else 4,
            0 if not lead else 1 if lead.isupper() else 2 if lead.islower() else 3 if lead.isdigit() or lead in "-*" else 4,
            blank,
            first and k == 0,
        )
        blank = not body.strip() and not m
    return out


def _blank(line: str) -> bool:
    return not line.strip()  # no marker matches a blank line


class RoleModel:
    """Log probabilities of starts, transitions and categories, smoothed by one."""

    def __init__(self, counts: dict[tuple[int, int, int], int]):
        """counts: (table, state, value): table 0 starts, 1 transitions from state to value, 2 + k categories of kind k."""
        self.start, self.step = np.ones(N_STATES), np.ones((N_STATES, N_STATES))
        self.seen = [np.ones((N_STATES, k)) for k in KINDS]
        for name, role in SPEAKERS.items():  # what a name means, before any count
            self.seen[0][2 * role, NAMES[name]] += 20
        for (table, state, value), n in counts.items():
            if table == 0:
                self.start[state] += n
            elif table == 1:
                self.step[state, value] += n
            else:
                self.seen[table - 2][state, value] += n
        self.start[1::2] = 1e-9  # a transcript begins with a turn
        for role in range(len(ROLES)):  # and a turn goes on in its own role
            for other in range(len(ROLES)):
                if other != role:
                    self.step[[2 * role, 2 * role + 1], 2 * other + 1] = 1e-9
        self.start, self.step = (np.log(x / x.sum(-1, keepdims=True)) for x in (self.start, self.step))
        self.seen = [np.log(x / x.sum(1, keepdims=True)) for x in self.seen]

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return sum(table[:, features[:, k]].T for k, table in enumerate(self.seen))

    def viterbi(self, features: np.ndarray, enter: int | None = None, leave: int | None = None) -> np.ndarray:
        """The likeliest states, between the states before and at the end where these are given; the first of equals."""
        seen = self.emissions(features)
        score, back = (self.start if enter is None else self.step[enter]) + seen[0], np.zeros((len(seen), N_STATES), np.int64)
        for k in range(1, len(seen)):
            paths = score[:, None] + self.step
            back[k] = paths.argmax(0)
            score = paths.max(0) + seen[k]
        states = np.zeros(len(seen), np.int64)
        states[-1] = score.argmax() if leave is None else leave
        for k in range(len(seen) - 1, 0, -1):
            states[k - 1] = back[k, states[k]]
        return states

    def sweep(self, features: np.ndarray, first: bool) -> np.ndarray:
        """The best score of the lines from each state before them (none, if they come first) to each state at their end."""
        seen = self.emissions(features)
        score = (np.tile(self.start, (N_STATES, 1)) if first else self.step) + seen[0]
        for row in seen[1:]:
            score = (score[:, :, None] + self.step).max(1) + row
        return score


def _labelled(roles, texts) -> tuple[list[str], list[int]]:
    """Lines and states of the turns that have a known role."""
    lines, states = [], []
    for role, text in zip(roles, texts, strict=True):
        if role in ROLES:
            own = (text or "").split("\n")
            lines += own
            states += [2 * ROLES.index(role)] + [2 * ROLES.index(role) + 1] * (len(own) - 1)
    return lines, states


def _count(batches):
    """Counts of the model's tables over labelled turns: roles, texts; whether they come first, follow a blank line, and the state before."""
    schema = pa.schema([("table", pa.int32()), ("state", pa.int32()), ("value", pa.int32()), ("n", pa.int64())])
    held: Counter = Counter()
    for batch in batches:
        for roles, texts, first, blank, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines, states = _labelled(roles, texts)
            if not lines:
                continue
            if first:
                held[0, states[0], 0] += 1
            elif before is not None:
                held[1, before, states[0]] += 1
            held.update((1, a, b) for a, b in zip(states, states[1:], strict=False))
            features = line_features(lines, blank, first)
            held.update((2 + k, s, int(v)) for s, row in zip(states, features, strict=True) for k, v in enumerate(row))
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in held], pa.int32()) for j in range(3)] + [pa.array(list(held.values()), pa.int64())], schema=schema)


def train_roles(labelled: DataFrame) -> RoleModel:
    """labelled: roles, texts of the turns of a transcript or of its parts; first, blank, before (see _count). All rows count."""
    counts = labelled.select("roles", "texts", "first", "blank", "before").mapInArrow(batchwise(_count), "table int, state int, value int, n long").groupBy("table", "state", "value").agg(F.sum("n").alias("n"))
    return RoleModel({(r.table, r.state, r.value): r.n for r in counts.collect()})  # N_STATES * (N_STATES + sum(KINDS)) rows at most


def parse_lines(text: str | None, model: RoleModel) -> list[tuple[str, str, int]]:
    """(role, text, lines) of a transcript's turns."""
    if not text or not text.strip():
        return []
    lines = text.split("\n")
    return [(role, body.strip(), n) for role, body, n in _turns(lines, model.viterbi(line_features(lines)))]


def _turns(lines: list[str], states) -> list[tuple[str, str, int]]:
    turns = []
    for line, state in zip(lines, states, strict=True):
        if state % 2 == 0 or not turns:
            turns.append((ROLES[state // 2], []))
        turns[-1][1].append(MARKER.sub("", line, count=1) if state % 2 == 0 else line)
    return [(role, "\n".join(body), len(body)) for role, body in turns]


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>\n"


def _parse(model):
    def run(batches):
        m = model.value
        for batch in batches:
            keys, out = batch.schema.names[:-1], []
            for k, text in enumerate(batch.column(len(keys)).to_pylist()):
                out += [(k, j, role, body, n, render(role, body)) for j, (role, body, n) in enumerate(parse_lines(text, m))]
                if len(out) >= 5000 or k + 1 == batch.num_rows and out:
                    at = pa.array([x[0] for x in out])
                    columns = [batch.column(c).take(at) for c in range(len(keys))]
                    columns += [pa.array([x[c] for x in out], t) for c, t in ((1, pa.int64()), (2, pa.string()), (3, pa.string()), (4, pa.int64()), (5, pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keys, "turn_no", "role", "text", "n_lines", "rendered"])
                    out = []

    return run


MADE = ("turn_no", "role", "text", "n_lines", "rendered")


def format_transcripts(transcripts: DataFrame, model: RoleModel, keys: list[str], text_col: str = "transcript") -> DataFrame:
    """A row a recovered turn: the keys, turn_no, role, text, n_lines, rendered."""
    spark = transcripts.sparkSession
    ship_package(spark)
    rows = transcripts.select(*(F.col(c).alias(f"key_{c}") for c in keys), F.col(text_col).alias("_transcript"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    made = "turn_no long, role string, text string, n_lines long, rendered string"
    turns = rows.mapInArrow(batchwise(_parse(spark.sparkContext.broadcast(model))), f"{fields}, {made}")
    return turns.select(*(F.col(f"key_{c}").alias(f"key_{c}" if c in MADE else c) for c in keys), *MADE)


# ---------------------------------------------------------------- dialogues kept as rows
#: Ways in which speakers are marked in the transcripts that the query makes of the dialogues.
STYLES = (("System: ", "User: ", "Assistant: "), ("[System] ", "[Human] ", "[AI] "), ("### System:\n", "### Instruction:\n", "### Response:\n"), ("Note: ", "Q: ", "A: "), ("**Context:** ", "**Customer:** ", "**Agent:** "))


def marked(conversations: DataFrame) -> DataFrame:
    """The text as a transcript has it: in one of STYLES; one marker in four is missing."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0
    marker: Column = F.lit("")
    for k, names in enumerate(STYLES):
        for role, name in zip(ROLES, names, strict=True):
            marker = F.when(~bare & (style == k) & (F.col("role") == role), F.lit(name)).otherwise(marker)
    return conversations.select("conv_id", "turn", "role", F.concat(marker, F.coalesce("text", F.lit(""))).alias("text"))


def _cut(rows: int, chars: int):
    """Sorted rows (conv_id, alone, role, text) to parts of dialogues."""

    def run(batches):
        base, seq, held, key = TaskContext.get().partitionId() << 32, 0, [], None
        kind, done, weight, size = None, [], 0, 0

        def close():
            nonlocal held, seq, size
            texts = [t for _, t in held]
            _, states = _labelled([r for r, _ in held], texts)
            done.append((key[0], base + seq if key[1] else -1, base + seq, [r for r, _ in held], texts, _blank(texts[-1].rpartition("\n")[2]), states[-1] if states else None))
            held, seq, size = [], seq + 1, 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((kind, pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.int32()))], names=["conv_id", "alone", "part", "roles", "texts", "ends_blank", "ends"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, alone, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (alone or (conv, alone) != key or len(held) >= rows or size >= chars):
                    close()
                key = conv, alone
                held.append((role, text))
                size, weight = size + len(text), weight + len(text)
                if weight >= 8 << 20 and done:
                    yield made()
                    done, weight = [], 0
        if held:
            close()
        if done:
            yield made()

    return run


def dialogue_parts(conversations: DataFrame, work: Workspace, rows: int = PART_ROWS, chars: int = PART_CHARS) -> tuple[DataFrame, DataFrame, int]:
    """Written tables of the parts, and of how those of dialogues of several parts follow each other, with their number.

    conversations: conv_id, turn, role, text. Parts: conv_id, alone, part, roles, texts, ends_blank, ends.
    """
    spark, alone = conversations.sparkSession, F.col("conv_id").isNull() | F.col("turn").isNull()
    order = ["conv_id", "alone", "turn", "_h"]
    dealt = conversations.withColumns({"alone": alone, "_h": F.xxhash64("role", "text")}).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    cut = dealt.select("conv_id", "alone", "role", "text").mapInArrow(batchwise(_cut(rows, chars)), f"conv_id {kind}, alone long, part long, roles array<string>, texts array<string>, ends_blank boolean, ends int")
    parts = work.write(cut, "parts")
    own = Window.partitionBy("conv_id", "alone")
    before = own.orderBy("part")  # small columns only, a row a part
    follow = parts.select("conv_id", "alone", "part", F.lag("ends_blank").over(before).alias("blank"), F.lag("ends").over(before).alias("before"), F.row_number().over(before).alias("k"), F.count("*").over(own).alias("of"))
    follow = work.write(follow.where("of > 1").select("conv_id", "alone", "part", (F.col("k") == 1).alias("first"), F.coalesce("blank", F.lit(False)).alias("blank"), "before"), "follow")
    return parts, follow, follow.count()


def _sweeps(model):
    def run(batches):
        m = model.value
        for batch in batches:
            conv, alone, part, texts, first, blank = batch.columns
            made = []
            for t, f, b in zip(texts.to_pylist(), first.to_pylist(), blank.to_pylist(), strict=True):
                lines = "\n".join(t).split("\n")
                made.append(m.sweep(line_features(lines, b, f), f).tobytes())
            yield pa.RecordBatch.from_arrays([conv, alone, part, first, pa.array(made, pa.binary())], names=["conv_id", "alone", "part", "first", "sweep"])

    return run


def _matrix(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw).reshape(-1, N_STATES)


def _forward(batches):
    """Parts in order: adds the best scores of all that goes before."""
    score = np.zeros(N_STATES)
    for batch in batches:
        made = []
        for first, raw in zip(batch.column("first").to_pylist(), batch.column("sweep").to_pylist(), strict=True):
            score = np.zeros(N_STATES) if first else score - score.max()  # only differences matter
            made.append(score.tobytes())
            score = (score[:, None] + _matrix(raw)).max(0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "score"])


def _backward(batches):
    """Parts in reverse order: the states before and at the end of each."""
    now, state = None, 0
    for batch in batches:
        made = []
        for conv, alone, first, raw, score in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "alone", "first", "sweep", "score")), strict=True):
            paths = _matrix(score)[0][:, None] + _matrix(raw)
            leave = int(paths.max(0).argmax()) if (conv, alone) != now else state
            now, state = (conv, alone), int(paths[:, leave].argmax())
            made.append((None if first else state, leave))
        yield pa.RecordBatch.from_arrays([batch.column("part"), *(pa.array(x, pa.int32()) for x in zip(*made, strict=True))], names=["part", "enter", "leave"])


def _pieces(model):
    """The turns of a part, or pieces of them: (conv_id, alone, part, place from the part's first new turn, new, role, text, n_lines)."""

    def run(batches):
        m = model.value
        for batch in batches:
            out = []
            for k, (texts, first, blank, enter, leave) in enumerate(zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True)):
                lines = "\n".join(texts).split("\n")
                states = m.viterbi(line_features(lines, blank, first), enter, leave)
                goes_on = int(not first and states[0] % 2)
                out += [(k, j - goes_on, j >= goes_on, *turn) for j, turn in enumerate(_turns(lines, states))]
            at = pa.array([x[0] for x in out])
            columns = [batch.column(c).take(at) for c in range(3)] + [pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64())) if c]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "alone", "part", "place", "new", "role", "text", "n_lines"])

    return run


def _join_pieces(batches):
    for batch in batches:
        conv, turn_no, role, pieces, n = batch.columns
        text = ["\n".join(x["text"] for x in p).strip() for p in pieces.to_pylist()]
        rendered = [render(r, t) for r, t in zip(role.to_pylist(), text, strict=True)]
        yield pa.RecordBatch.from_arrays([conv, turn_no, role, pa.array(text, pa.string()), n, pa.array(rendered, pa.string())], names=["conv_id", *MADE])


def _long_dialogues(parts: DataFrame, follow: DataFrame, many: int, model: RoleModel, work: Workspace) -> DataFrame:
    """The turns of dialogues of several parts."""
    spark = parts.sparkSession
    shared, kind, n = spark.sparkContext.broadcast(model), parts.schema["conv_id"].dataType.simpleString(), partitions(spark)
    key = f"conv_id {kind}, alone long, part long"
    own = parts.join(few(follow.select("part", "first", "blank"), many), "part").select("conv_id", "alone", "part", "texts", "first", "blank")
    sweeps = own.mapInArrow(batchwise(_sweeps(shared)), f"{key}, first boolean, sweep binary").repartition(n, "conv_id", "alone")
    scores = sweeps.sortWithinPartitions("conv_id", "alone", "part").mapInArrow(_forward, f"{key}, first boolean, sweep binary, score binary")
    back = work.write(scores, "scores").repartition(n, "conv_id", "alone").sortWithinPartitions("conv_id", "alone", F.desc("part"))
    path = work.write(back.mapInArrow(_backward, "part long, enter int, leave int"), "path")
    pieces = own.join(few(path, many), "part").select("conv_id", "alone", "part", "texts", "first", "blank", "enter", "leave")
    pieces = work.write(pieces.mapInArrow(batchwise(_pieces(shared)), f"{key}, place long, new boolean, role string, text string, n_lines long"), "pieces")
    news = pieces.groupBy("conv_id", "alone", "part").agg(F.sum(F.col("new").cast("long")).alias("news"))
    before = Window.partitionBy("conv_id", "alone").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = work.write(news.select("part", F.coalesce(F.sum("news").over(before), F.lit(0)).alias("base")), "base")
    turns = pieces.join(few(base, many), "part").groupBy("conv_id", "alone", (F.col("base") + F.col("place")).alias("turn_no"))
    whole = turns.agg(F.min_by("role", "part").alias("role"), F.sort_array(F.collect_list(F.struct("part", "text"))).alias("pieces"), F.sum("n_lines").alias("n_lines"))
    return whole.select("conv_id", "turn_no", "role", "pieces", "n_lines").mapInArrow(batchwise(_join_pieces), f"conv_id {kind}, turn_no long, role string, text string, n_lines long, rendered string")


def format_dialogues(conversations: DataFrame, rows: int = PART_ROWS, chars: int = PART_CHARS) -> DataFrame:
    """The dialogues as transcripts, parsed again without their labels: conv_id, turn_no, role, text, n_lines, rendered.

    The model learns from the conversations for which crc32 of the id as text, modulo 10, is not 0.
    """
    work = Workspace(conversations.sparkSession, "dialogues")
    parts, follow, many = dialogue_parts(marked(conversations), work, rows, chars)
    held = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 10 == 0
    beside = few(follow.select("part", "first", "blank", "before"), many)
    model = train_roles(parts.where(~held).join(beside, "part", "left").withColumns({"first": F.coalesce("first", F.lit(True)), "blank": F.coalesce("blank", F.lit(False))}))
    single = parts.join(few(follow.select("part"), many), "part", "left_anti") if many else parts
    turns = format_transcripts(single.select("conv_id", F.array_join("texts", "\n").alias("transcript")), model, ["conv_id"])
    return turns.union(_long_dialogues(parts, follow, many, model, work)) if many else turns
