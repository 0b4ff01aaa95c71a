"""Operator 12: conversation structure repair by deduplicated signatures.

A conversation's rows become a compact string, one letter a row: what its role begins with and which fault it has. Most
conversations share their string with many others, so each distinct one is solved once, by a memoised recursion, and the
answer is joined back and replayed on the rows.

Rows are put in order by ranges, so that a very long conversation lies in many tasks, and are cut into chunks of at most
``CHUNK`` rows. A chunk's answer holds, for each state in which it can begin and end, the least cost and the edits; a
conversation is then a shortest path over its chunks. Where chunks are cut doesn't change the result: an edit's letter
leads to one state only, so the first chunk in which two paths differ decides which of them is less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_batches, table, temporary

#: Rows, and bytes of text, of a chunk; a single row may have more bytes.
CHUNK, CHUNK_BYTES = 128, 1_000_000
#: Costs: a new role, a deletion, an insertion, a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NONE = 1 << 40

#: What a state may be followed by: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that is due in each state; a system row may come at the start besides.
DUE = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {"u": "user", "a": "assistant"}
#: Edits after the last row that make each state one that a conversation may end in.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


@dataclass(frozen=True)
class Answer:
    """``cost[i][j]`` of a chunk that is entered in state i and left in state j, and its edits; NONE where there is no way."""

    cost: list[list[int]]
    edits: list[list[str]]


def solve(signature: str) -> Answer:
    """Cheapest edits of a signature between all states, ASCII-least where several cost the same.

    Letters: x goes; s, u, a and o (any other role) may stay; capitals are truncated. After two insertions in a row a
    third would only come back to a state already passed, so a run of them has two at most.
    """

    def ways(i: int, state: int, inserted: int) -> Iterator[tuple[str, int, tuple[int, int, int]]]:
        letter = signature[i]
        yield "D", DELETE, (i + 1, state, 0)
        if inserted < 2:
            yield "I", INSERT, (i, AFTER[DUE[state]], inserted + 1)
        if letter != "x":
            stays = TRUNCATED if letter.isupper() else 0
            role = letter.lower()
            if role == DUE[state] or (role == "s" and state == START):
                yield "K", stays, (i + 1, AFTER[role], 0)
            if role != DUE[state]:
                yield "R", REROLE + stays, (i + 1, AFTER[DUE[state]], 0)

    @cache
    def best(i: int, state: int, inserted: int) -> tuple[int, ...]:
        if i == len(signature):
            # insertions belong to the row after them, or to the conversation's end
            return tuple(0 if inserted == 0 and s == state else NONE for s in range(4))
        found = [NONE] * 4
        for _, cost, to in ways(i, state, inserted):
            found = [min(a, cost + b) for a, b in zip(found, best(*to))]
        return tuple(found)

    def edits(state: int, end: int) -> str:
        at, out = (0, state, 0), []
        left = best(*at)[end]
        while at[0] < len(signature):
            letter, cost, at = min((w for w in ways(*at) if w[1] + best(*w[2])[end] == left), key=lambda w: w[0])
            left -= cost
            out.append(letter)
        return "".join(out)

    cost = [[min(c, NONE) for c in best(0, s, 0)] for s in range(4)]
    return Answer(cost, [[edits(s, e) if cost[s][e] < NONE else "" for e in range(4)] for s in range(4)])


def path(answers: list[Answer]) -> tuple[int, list[tuple[int, str]], str]:
    """Least cost of a conversation's chunks, the state in which each is entered with its edits, and the edits after the last row."""
    ahead = [[INSERT * len(CLOSING[s]) for s in range(4)]]
    for a in reversed(answers):
        ahead.append([min(a.cost[s][e] + ahead[-1][e] for e in range(4)) for s in range(4)])
    ahead.reverse()
    state, out = START, []
    for a, here, after in zip(answers, ahead, ahead[1:]):
        edits, end = min((a.edits[state][e], e) for e in range(4) if a.cost[state][e] + after[e] == here[state] and a.cost[state][e] < NONE)
        out.append((state, edits))
        state = end
    return ahead[0][START], out, CLOSING[state]


def replay(state: int, edits: str, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each row that is there after the edits."""
    row = 0
    for e in edits:
        if e == "I":
            due = DUE[state]
            yield e, NAMES[due], ""
        elif e == "D":
            row += 1
            continue
        else:
            due = DUE[state] if e == "R" else roles[row][:1]
            yield e, NAMES[due] if e == "R" else roles[row], texts[row]
            row += 1
        state = AFTER[due]


def legal(before: str, after: str) -> bool:
    return before[:1] + after[:1] in ("su", "ua", "au")


CHUNKS = "conv long, chunk long, signature string, roles array<string>, texts array<string>, first_role string, last_role string, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long"


def _chunked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Chunks of at most ``most`` of the sorted rows (part, conv, turn, role, text, n, first, last): ``n`` equal rows, the first of which is new if ``first``."""
    schema = pa.schema([("conv", pa.int64()), ("chunk", pa.int64()), ("signature", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("first_role", pa.string()), ("last_role", pa.string())] + [(c, pa.int64()) for c in ("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")])
    number, size, now, done, held = 0, 0, None, [], 0

    def closed() -> None:
        nonlocal now, number
        if now is not None:
            now["signature"] = "".join(now["signature"])
            done.append(now)
            number += 1
        now = None

    for batch in batches:
        for part, conv, turn, role, text, n, first, last in zip(*(batch.column(i).to_pylist() for i in range(8))):
            for copy in range(n):
                if now is None or now["conv"] != conv or len(now["roles"]) >= most or size > CHUNK_BYTES:
                    closed()
                    size = 0
                    now = {"conv": conv, "chunk": (part << 40) + number, "signature": [], "roles": [], "texts": [], "first_role": role, "last_role": None, "first_turn": None, "last_turn": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                fault = "blank" if not last else "duplicate" if copy or not first else "truncated" if last not in ".!?" else ""
                letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
                now["signature"].append("x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
                if fault:
                    now[fault] += 1
                if now["last_role"] is not None:
                    now["illegal"] += not legal(now["last_role"], role)
                if turn is not None and turn != now["last_turn"]:
                    now["turns"] += 1
                    now["first_turn"] = turn if now["first_turn"] is None else now["first_turn"]
                    now["last_turn"] = turn
                now["last_role"] = role
                now["roles"].append(role)
                now["texts"].append(text)
                size += len(text)
                held += len(text) + 100
                if held > 4_000_000 and done:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done, held = [], 0
    closed()
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Rows of one conversation after the other, as they come; they are sorted."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                yield from batch.slice(low, 256).to_pylist()

    yield from groupby(rows(), key=lambda r: r["conv"])


class Repair:
    """The repaired conversations of ``rows``: ``report()`` has a row for each, ``turns()`` their rows after the edits.

    Rows are taken by turn (missing turns first), then role and text, so equal rows are neighbours. Missing roles and
    texts count as one space, so such a text is blank; rows without an id are one conversation. A row's first fault counts:
    blank, duplicate (role and text seen earlier in the conversation), truncated (its last character other than white
    space isn't ``.``, ``!`` or ``?``). After the edits a conversation is empty, or a system row may be followed by user
    and assistant rows in turn. An empty table has no conversations. A conversation's edits are one string, so its chunks'
    answers are in one task's memory (some 3 KB for 128 rows); its texts never are.
    """

    def __init__(self, rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK):
        space = F.lit(" ")
        x = rows.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"), F.coalesce(F.col(text_col).cast("string"), space).alias("text"))
        # equal rows are one row with their number, whatever task they came from
        x = x.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
        x = x.withColumn("key", F.sha2(F.concat(F.coalesce(F.col("conv").cast("string"), space), F.lit(":"), F.length("role"), F.lit(":"), "role", "text"), 256))
        x = x.withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
        earliest = x.groupBy("key").agg(F.min("at").alias("earliest"))
        last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
        flagged = x.join(earliest, "key").select("conv", "turn", "role", "text", "n", (F.col("at") == F.col("earliest")).alias("first"), last.alias("last"))
        spark = rows.sparkSession
        self.spark = spark

        def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _chunked(batches, chunk)

        with temporary(spark):
            flagged = materialize(flagged, "conversation-rows")
            order = ["conv", "turn", "role", "text"]
            placed = flagged.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("part"), *order, "n", "first", "last")
            self.chunks = materialize(placed.mapInArrow(chunks, CHUNKS), "chunks", keep=True)
            answers = materialize(self.chunks.select("signature").distinct().mapInArrow(_solved, "signature string, cost array<long>, edits array<string>"), "signatures")
            found = self.chunks.drop("roles", "texts").join(answers, "signature").drop("signature")
            found = found.repartition("conv").sortWithinPartitions("conv", "chunk")
            self.paths = materialize(found.mapInArrow(_paths, PATHS), "edits", keep=True)

    def _joined(self) -> DataFrame:
        x = self.chunks.select("conv", "chunk", "roles", "texts").join(self.paths.drop("conv"), "chunk")
        return x.repartition("conv").sortWithinPartitions("conv", "chunk")

    def turns(self) -> DataFrame:
        """conv_id, position (from 0), edit (K, R or I), role, text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for conv, chunks in _conversations(batches):
                position = 0
                for c in chunks:
                    out = list(replay(c["state"], c["edits"], c["roles"], c["texts"]))
                    columns = [pa.array(list(x), pa.string()) for x in zip(*out)] or [pa.array([], pa.string())] * 3
                    yield pa.RecordBatch.from_arrays([pa.array([conv] * len(out), pa.int64()), pa.array(range(position, position + len(out)), pa.int64()), *columns], ["conv_id", "position", "edit", "role", "text"])
                    position += len(out)

        return self._joined().mapInArrow(run, "conv_id long, position long, edit string, role string, text string")

    def report(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; conversations without rows aren't known here."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for conv, chunks in _conversations(batches):
                digest, audit, n, told = hashlib.sha256(), [], 0, None
                for c in chunks:
                    for _, role, text in replay(c["state"], c["edits"], c["roles"], c["texts"]):
                        digest.update(("\n" if n else "").encode() + f"{role}:{text}".encode())
                        n += 1
                    audit.append(c["edits"])
                    told = c["told"] or told
                values = {"conv_id": conv, **told, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
                yield pa.RecordBatch.from_arrays([pa.array([values[k]], t) for k, t in REPORT.items()], list(REPORT))

        with small_batches(self.spark):
            return materialize(self._joined().mapInArrow(run, ", ".join(f"{k} {'string' if t == pa.string() else 'long'}" for k, t in REPORT.items())), "repaired", keep=True)


REPORT = {"conv_id": pa.int64(), **{c: pa.int64() for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}, "audit": pa.string(), "repaired_sha256": pa.string()}


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            part = batch.slice(low, 512)
            answers = [solve(s) for s in part.column(0).to_pylist()]
            cost = pa.array([[c for row in a.cost for c in row] for a in answers], pa.list_(pa.int64()))
            edits = pa.array([[e for row in a.edits for e in row] for a in answers], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column(0), cost, edits], ["signature", "cost", "edits"])


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PATHS = "conv long, chunk long, state int, edits string, told struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's entry state and edits; the last of a conversation has those at its end too, and its counts."""
    told_type = pa.struct([(c, pa.int64()) for c in COUNTS])
    for conv, chunks in _conversations(batches):
        answers, numbers, told, before = [], [], dict.fromkeys(COUNTS, 0), None
        turns, least, most = 0, None, None
        for c in chunks:
            answers.append(Answer([c["cost"][4 * s : 4 * s + 4] for s in range(4)], [c["edits"][4 * s : 4 * s + 4] for s in range(4)]))
            numbers.append(c["chunk"])
            for k in ("blank", "duplicate", "truncated", "illegal"):
                told[k] += c[k]
            if before is not None:
                told["illegal"] += not legal(before, c["first_role"])
            if c["turns"]:
                turns += c["turns"] - (most == c["first_turn"])
                least, most = c["first_turn"] if least is None else least, c["last_turn"]
            before = c["last_role"]
        told["gaps"] = most - least + 1 - turns if turns else 0
        told["cost"], found, closing = path(answers)
        found[-1] = found[-1][0], found[-1][1] + closing
        for low in range(0, len(numbers), 4096):
            part = found[low : low + 4096]
            n = len(part)
            ends = [None] * n
            if low + n == len(numbers):
                ends[-1] = told
            yield pa.RecordBatch.from_arrays([pa.array([conv] * n, pa.int64()), pa.array(numbers[low : low + n], pa.int64()), pa.array([s for s, _ in part], pa.int32()), pa.array([e for _, e in part], pa.string()), pa.array(ends, told_type)], ["conv", "chunk", "state", "edits", "told"])


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults that a row's id and turn choose: gone, emptied, without stops, twice, said by the user. Missing values are one space."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    x = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return x.where("how <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("_copy")).drop("_copy")


def repaired_or_empty(every: DataFrame, report: DataFrame) -> DataFrame:
    """``report`` with a row for each conversation of ``every`` (conv_id): those without rows have zeros, no edits and the hash of nothing."""
    ids = every.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    x = ids.join(report, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    return x.select(F.col("_id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, damaged and repaired."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repaired_or_empty(rows, Repair(damaged(rows)).report())
