"""Conversation structure repair by rank-convergence parallel Viterbi.

A conversation's rows, in order, are kept (K), given the role that fits (R), deleted (D) or preceded by an inserted
turn without text (I), at least cost, so that the roles read ``(s?(ua)+)?``. What may follow depends on one of four
states only: nothing yet, after a system turn, after a user turn, after an assistant turn. Backward, row by row,
a vector holds the least cost of the rest for each state.

Rows are dealt out by range of (conversation, turn, role, text) and cut into chunks, so that a conversation of
any length is spread over many tasks. Every chunk runs backward at once from a speculative vector. Rows of the (min, +)
recursion soon forget where they started: the vectors of two starts come to differ only by a constant, which changes no
decision. So a chunk whose right neighbour ended elsewhere than assumed is run again from its right end only until
the vector is the stored one up to a constant; passes go on until no border disagrees. A pass carries vectors
through blocks of neighbouring chunks, 8 times more with each pass, so that even rows that never forget (roles that are none
of the three) need a logarithmic number of passes. Vectors are stored without their constant, four small numbers a row.

With the vectors stitched together, a forward trace takes the ASCII-least letter that keeps the cost least. A chunk's
trace depends on the state in which it is entered: conversations of several chunks are traced from all four, and the
states are handed on along the chunks, some bytes each.

Defined cases: null ``role`` and ``text`` count as one space; null turns come first and play no part in gaps; a null
conv_id is a conversation of its own. Rows of one turn are taken by role, then by a digest of role and text; equal rows
count as often as they occur. A role is judged by its first character; others than s, u, a (an empty role, too) cannot be kept. Extra columns
are not read. An empty table gives empty results. The hash of a whole conversation, which ``digest`` needs, is sequential
by its nature: its rows stream through one task in order, never held together.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from featlens.session import materialize

#: Rows of a chunk.
CHUNK = 4096
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
INITIALS = "sua"
ROLES = {"u": "user", "a": "assistant"}
#: States: 0 nothing, 1 after s, 2 after u, 3 after a. The role that an inserted or changed turn must have, and where it leads.
FITS = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
KEEPS = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
LEGAL = {(0, 1), (1, 2), (2, 1)}
OPEN = {0: "", 1: "ua", 2: "a", 3: ""}      # what must be inserted at the end
DEAD = 8                                     # the symbol of a row that must go


def _pack(v) -> int:
    low = min(v)
    return sum((x - low) << 4 * s for s, x in enumerate(v))


END = _pack([INSERT * len(OPEN[s]) for s in range(4)])


def _unpack(code: int) -> list[int]:
    return [code >> 4 * s & 15 for s in range(4)]


def _costs(code: int, symbol: int) -> tuple[list[int], list[int]]:
    """(vector behind the row, vector before it and its insertions), with one constant."""
    after, pay, initial = _unpack(code), TRUNCATED * (symbol >> 2), symbol & 3
    row = []
    for s in range(4):
        ways = [DELETE + after[s], REROLE + pay + after[FITS[s][1]]]
        if (s, initial) in KEEPS:
            ways.append(pay + after[KEEPS[s, initial]])
        row.append(min(ways))
    before = []
    for s in range(4):
        one = FITS[s][1]
        before.append(min(row[s], INSERT + row[one], 2 * INSERT + row[FITS[one][1]]))
    return after, before


@lru_cache(None)
def step(code: int, symbol: int) -> int:
    """The vector before a row, from the one behind it, both without their constants (16 bits: no two states
    are further apart than 15). A row that must go costs every state the same."""
    return code if symbol == DEAD else _pack(_costs(code, symbol)[1])


@lru_cache(None)
def moves(code: int, symbol: int, state: int) -> tuple[str, int, int]:
    """(letters, next state, cost) for a row that can stay, entered in ``state``: the least letters of least cost."""
    after, before = _costs(code, symbol)
    letters, cost, pay, initial = "", 0, TRUNCATED * (symbol >> 2), symbol & 3
    while True:
        want = before[state]
        if DELETE + after[state] == want:
            return letters + "D", state, cost + DELETE
        if INSERT + before[FITS[state][1]] == want:
            letters, cost, state = letters + "I", cost + INSERT, FITS[state][1]
            continue
        kept = KEEPS.get((state, initial))
        if kept is not None and pay + after[kept] == want:
            return letters + "K", kept, cost + pay
        return letters + "R", FITS[state][1], cost + REROLE + pay


def backward(symbols: bytes, right: int, old: list[int] | None = None) -> list[int]:
    """The vector before every row of a chunk; with ``old`` vectors, only as far as they differ by more than a constant."""
    codes = list(old) if old else [0] * len(symbols)
    code = right
    for i in range(len(symbols) - 1, -1, -1):
        code = step(code, symbols[i])
        if old and code == old[i]:
            break
        codes[i] = code
    return codes


def _pairs_illegal(a, b) -> bool:
    return (a, b) not in LEGAL


# ------------------------------------------------------------------ rows and their faults

def tidy(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with null roles and texts as one space."""
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def _mark():
    return F.md5(F.concat("role", F.lit("\x00"), "text"))


def cells(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a turn, without their text: ``conv_id, turn, role, mark, copies``, the number of
    blank, duplicate and truncated ones, and ``symbol`` of the one that may stay (DEAD: none)."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    d = rows.select("conv_id", "turn", "role", _mark().alias("mark"), (body == "").alias("blank"),
                    (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    d = d.groupBy("conv_id", "turn", "role", "mark").agg(F.count(F.lit(1)).alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    d = materialize(d)
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = d.groupBy("conv_id", "mark").agg(F.min(when).alias("at")).select(F.col("conv_id").alias("c_"), F.col("mark").alias("m_"), "at")
    d = d.join(first, d.conv_id.eqNullSafe(first.c_) & (d.mark == first.m_))
    new = (~F.col("blank") & (when == F.col("at"))).cast("int")     # the first such row of the conversation is among the copies
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1
    initial = F.when((F.length("role") > 0) & (initial >= 0), initial).otherwise(len(INITIALS))
    symbol = F.when(new == 1, initial + F.when(F.col("cut"), 4).otherwise(0)).otherwise(DEAD)
    return materialize(d.select(
        "conv_id", "turn", "role", "mark", "copies", initial.cast("int").alias("initial"), symbol.cast("int").alias("symbol"),
        F.when(F.col("blank"), F.col("copies")).otherwise(0).alias("blank"),
        F.when(~F.col("blank"), F.col("copies") - new).otherwise(0).alias("duplicate"),
        F.when(F.col("cut") & (new == 1), 1).otherwise(0).cast("long").alias("truncated")))


def faults(cells: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated`` of every conversation."""
    d = cells.groupBy("conv_id", "turn").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return d.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])


# ------------------------------------------------------------------ chunks

def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def chunks(cells: DataFrame, size: int = CHUNK) -> DataFrame:
    """A row for every ``size`` cells of a conversation, in order, and ``k``, its place among the conversation's chunks."""
    keys = ("conv_id", "turn", "role", "mark")
    d = cells.select(*keys, "copies", "initial", "symbol").repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = (f"conv_id {_type(cells, 'conv_id')}, id bigint, turns array<{_type(cells, 'turn')}>, roles array<string>, marks array<string>, "
              "copies array<bigint>, symbols binary, head int, last int, illegal bigint")
    kinds = [cells.select(c).schema.fields[0].dataType for c in ("conv_id", "turn")]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        conv_kind, turn_kind = map(to_arrow_type, kinds)
        out_schema = pa.schema([("conv_id", conv_kind), ("id", pa.int64()), ("turns", pa.list_(turn_kind)), ("roles", pa.list_(pa.string())), ("marks", pa.list_(pa.string())),
                                ("copies", pa.list_(pa.int64())), ("symbols", pa.binary()), ("head", pa.int32()), ("last", pa.int32()), ("illegal", pa.int64())])
        number = TaskContext.get().partitionId() << 40
        ready, held, now = [], 0, None

        def close(c):
            nonlocal number
            turns, roles, marks, copies, symbols, initials = zip(*c[1])
            illegal = sum(m - 1 for m in copies) + sum(map(_pairs_illegal, initials, initials[1:]))
            ready.append((c[0], number, turns, roles, marks, copies, bytes(symbols), initials[0], initials[-1], illegal))
            number += 1

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*ready), out_schema)], schema=out_schema)
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for conv, *cell in zip(cols["conv_id"], cols["turn"], cols["role"], cols["mark"], cols["copies"], cols["symbol"], cols["initial"]):
                if now is None or now[0] != conv or len(now[1]) >= size:
                    if now is not None:
                        close(now)
                    now = (conv, [])
                now[1].append(cell)
                held += 1
                if held >= 4 * CHUNK and ready:
                    yield flush()
                    ready, held = [], 0
        if now is not None:
            close(now)
        if ready:
            yield flush()
    d = materialize(d.mapInArrow(run, schema))
    along = W.partitionBy("conv_id").orderBy("id")
    place = d.select("id", (F.row_number().over(along) - 1).cast("long").alias("k"), F.lead("id").over(along).alias("next"),
                     F.lead("head").over(along).alias("next_head"))
    return materialize(d.join(place, "id"))


# ------------------------------------------------------------------ backward passes

_STATE = "id bigint, k bigint, next bigint, symbols binary, right int, codes array<int>"


def _emit(rows: list, names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(len(names))], schema=schema)


def vectors(chunks: DataFrame) -> DataFrame:
    """``id, right, codes``: the vector behind each chunk and those before its rows, right up to constants."""
    def speculate(batches):
        schema = pa.schema([("id", pa.int64()), ("right", pa.int32()), ("codes", pa.list_(pa.int32()))])
        for batch in batches:
            rows = [(i, END, backward(s, END)) for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if rows:
                yield _emit(rows, ["id", "right", "codes"], schema)
    d = materialize(chunks.select("id", "symbols").mapInArrow(speculate, "id bigint, right int, codes array<int>"))
    along = chunks.select("conv_id", "id", "k", "next", "symbols").where("k > 0 or next is not null")
    if along.limit(1).count() == 0:
        return d
    keys = chunks.select(F.col("conv_id"), "id", "k", "next", "symbols").where("k > 0 or next is not null")
    state = d.join(keys, "id")
    alone = d.join(keys.select("id"), "id", "left_anti")
    reach = 0
    while True:
        left = state.select(F.col("id").alias("n_"), F.col("codes")[0].alias("want"))
        state = state.join(left, state.next == left.n_, "left").drop("n_").withColumn("want", F.coalesce("want", F.lit(END)))
        state = materialize(state)
        if state.where("right <> want").limit(1).count() == 0:
            return alone.unionByName(state.select("id", "right", "codes"))
        reach += 3
        state = state.withColumn("block", F.shiftright("k", min(reach, 62))).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", F.col("k").desc())
        fixed = state.select("id", "next", "symbols", "right", "codes", "want").mapInArrow(_fix_up, "id bigint, right int, codes array<int>")
        state = materialize(fixed).join(keys, "id")


def _fix_up(batches):
    """Runs chunks again whose right vector isn't the one assumed; a block's chunks come from right to left."""
    schema = pa.schema([("id", pa.int64()), ("right", pa.int32()), ("codes", pa.list_(pa.int32()))])
    before, carried = None, None
    for batch in batches:
        rows = []
        for i, following, symbols, right, codes, want in zip(*(c.to_pylist() for c in batch.columns)):
            now = carried if following is not None and following == before else want
            if now != right:
                codes = backward(symbols, now, codes)
            before, carried = i, codes[0]
            rows.append((i, now, codes))
        if rows:
            yield _emit(rows, ["id", "right", "codes"], schema)


# ------------------------------------------------------------------ forward trace

def _through(symbols: bytes, codes: list[int], right: int, state: int) -> int:
    for symbol, code in zip(symbols, [*codes[1:], right]):
        if symbol != DEAD:
            state = moves(code, symbol, state)[1]
    return state


def entries(d: DataFrame) -> DataFrame:
    """``id, entry``: the state in which each chunk of ``d`` (several a conversation) is entered."""
    def exits(batches):
        schema = pa.schema([("id", pa.int64()), ("exits", pa.list_(pa.int32()))])
        for batch in batches:
            rows = [(i, [_through(s, c, r, e) for e in range(4)]) for i, s, c, r in zip(*(x.to_pylist() for x in batch.columns))]
            if rows:
                yield _emit(rows, ["id", "exits"], schema)

    def hand_on(batches):
        schema, state = pa.schema([("id", pa.int64()), ("entry", pa.int32())]), 0
        for batch in batches:
            rows = []
            for i, k, out in zip(*(x.to_pylist() for x in batch.columns)):
                state = 0 if k == 0 else state
                rows.append((i, state))
                state = out[state]
            if rows:
                yield _emit(rows, ["id", "entry"], schema)
    out = d.select("id", "symbols", "codes", "right").mapInArrow(exits, "id bigint, exits array<int>")
    out = out.join(d.select("id", "conv_id", "k"), "id").repartition("conv_id").sortWithinPartitions("conv_id", "k")
    return out.select("id", "k", "exits").mapInArrow(hand_on, "id bigint, entry int")


def traces(chunks: DataFrame) -> DataFrame:
    """A row for every chunk: ``conv_id, k, audit, cost, closing`` (the roles inserted at the end) and ``edits``, the rows that stay:
    ``turn, role, mark``, the roles inserted before (``ahead``) and the role it gets, if another (``becomes``)."""
    d = chunks.join(vectors(chunks), "id")
    several = d.where("k > 0 or next is not null")
    entry = entries(several) if several.limit(1).count() else chunks.select("id", F.lit(0).alias("entry")).where("false")
    d = d.join(entry, "id", "left")
    conv, turn = _type(chunks, "conv_id"), chunks.schema["turns"].dataType.elementType.simpleString()
    kind = f"array<struct<turn:{turn},role:string,mark:string,ahead:string,becomes:string>>"
    kinds = [chunks.schema["conv_id"].dataType, chunks.schema["turns"].dataType.elementType]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        conv_kind, turn_kind = map(to_arrow_type, kinds)
        edit = pa.struct([("turn", turn_kind), ("role", pa.string()), ("mark", pa.string()), ("ahead", pa.string()), ("becomes", pa.string())])
        schema = pa.schema([("conv_id", conv_kind), ("k", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()), ("closing", pa.string()), ("edits", pa.list_(edit))])
        for batch in batches:
            rows, held = [], 0
            for conv_id, k, following, turns, roles, marks, copies, symbols, right, codes, state in zip(*(c.to_pylist() for c in batch.columns)):
                audit, cost, edits = [], 0, []
                state = state or 0
                for turn, role, mark, n, symbol, code in zip(turns, roles, marks, copies, symbols, [*codes[1:], right]):
                    if symbol != DEAD:
                        letters, after, paid = moves(code, symbol, state)
                        audit.append(letters)
                        cost, n = cost + paid, n - 1
                        ahead = ""
                        for _ in letters[:-1]:
                            role_, state = FITS[state]
                            ahead += role_
                        if letters[-1] != "D":
                            edits.append({"turn": turn, "role": role, "mark": mark, "ahead": ahead, "becomes": ROLES[FITS[state][0]] if letters[-1] == "R" else None})
                        state = after
                    audit.append("D" * n)
                    cost += DELETE * n
                closing = OPEN[state] if following is None else ""
                rows.append((conv_id, k, "".join(audit) + "I" * len(closing), cost + INSERT * len(closing), closing, edits))
                held += len(symbols)
                if held >= 4 * CHUNK:
                    yield _emit(rows, schema.names, schema)
                    rows, held = [], 0
            if rows:
                yield _emit(rows, schema.names, schema)
    d = d.select("conv_id", "k", "next", "turns", "roles", "marks", "copies", "symbols", "right", "codes", "entry")
    return materialize(d.mapInArrow(run, f"conv_id {conv}, k bigint, audit string, cost bigint, closing string, edits {kind}"))


def audits(chunks: DataFrame, traces: DataFrame) -> DataFrame:
    """``conv_id, illegal, cost, audit`` of every conversation."""
    border = F.when(F.col("next").isNotNull() & ~F.struct("last", "next_head").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in sorted(LEGAL)]), 1).otherwise(0)
    illegal = chunks.groupBy("conv_id").agg(F.sum(F.col("illegal") + border).cast("long").alias("illegal"))
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "audit"))), lambda x: x["audit"]), "")
    told = traces.groupBy(F.col("conv_id").alias("c_")).agg(F.sum("cost").cast("long").alias("cost"), letters.alias("audit"))
    return illegal.join(told, F.col("conv_id").eqNullSafe(F.col("c_"))).drop("c_")


# ------------------------------------------------------------------ repaired rows

def _merged(rows: DataFrame, traces: DataFrame) -> DataFrame:
    """Texts and edits of every conversation in order, an edit just ahead of the row that it is about."""
    null = F.lit(None)
    e = traces.select("conv_id", F.explode("edits").alias("e")).select("conv_id", F.lit(0).alias("tail"), "e.turn", "e.role", "e.mark", F.lit(0).alias("what"), "e.ahead", "e.becomes", null.cast("string").alias("text"))
    t = rows.select("conv_id", F.lit(0).alias("tail"), "turn", "role", _mark().alias("mark"), F.lit(1).alias("what"), null.cast("string").alias("ahead"), null.cast("string").alias("becomes"), "text")
    c = traces.where("closing <> ''").select("conv_id", F.lit(1).alias("tail"), null.cast(_type(rows, "turn")).alias("turn"), null.cast("string").alias("role"), null.cast("string").alias("mark"),
                                             F.lit(0).alias("what"), F.col("closing").alias("ahead"), null.cast("string").alias("becomes"), null.cast("string").alias("text"))
    d = e.unionByName(t).unionByName(c).repartition("conv_id")
    return d.sortWithinPartitions("conv_id", "tail", "turn", "role", "mark", "what").select("conv_id", "tail", "turn", "role", "what", "ahead", "becomes", "text")


def _read(batches):
    """(conv_id, edit, turn, role, text) of the repaired rows; edit is K, R or I."""
    edit = None
    for batch in batches:
        for conv, tail, turn, role, what, ahead, becomes, text in zip(*(c.to_pylist() for c in batch.columns)):
            if what == 0:
                for r in ahead:
                    yield conv, "I", None, ROLES[r], ""
                edit = None if tail else (becomes or role, "R" if becomes else "K")
            elif edit is not None:
                yield conv, edit[1], turn, edit[0], text
                edit = None


def repaired(rows: DataFrame, traces: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, position, edit, turn, role, text``, one row a turn, rows of a conversation in order."""
    conv, turn = _type(rows, "conv_id"), _type(rows, "turn")
    kinds = [rows.schema[c].dataType for c in ("conv_id", "turn")]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        conv_kind, turn_kind = map(to_arrow_type, kinds)
        schema = pa.schema([("conv_id", conv_kind), ("position", pa.int64()), ("edit", pa.string()), ("turn", turn_kind), ("role", pa.string()), ("text", pa.string())])
        out, size, position, last = [], 0, 0, object()
        for conv, *row in _read(batches):
            position = position + 1 if conv == last else 0
            last = conv
            out.append((conv, position, *row))
            size += len(row[-1]) + 64
            if size >= 4 << 20:
                yield _emit(out, schema.names, schema)
                out, size = [], 0
        if out:
            yield _emit(out, schema.names, schema)
    return _merged(rows, traces).mapInArrow(run, f"conv_id {conv}, position bigint, edit string, turn {turn}, role string, text string")


def hashes(rows: DataFrame, traces: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the conversations that keep a row: ``role:text`` of the repaired rows, joined by line ends."""
    kind = rows.schema["conv_id"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        schema = pa.schema([("conv_id", to_arrow_type(kind)), ("repaired_sha256", pa.string())])
        out, last, sha = [], None, None
        for conv, _, _, role, text in _read(batches):
            if sha is not None and conv == last:
                sha.update(b"\n")
            else:
                if sha is not None:
                    out.append((last, sha.hexdigest()))
                sha, last = hashlib.sha256(), conv
            sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if len(out) >= 10_000:
                yield _emit(out, schema.names, schema)
                out = []
        if sha is not None:
            out.append((last, sha.hexdigest()))
        if out:
            yield _emit(out, schema.names, schema)
    return _merged(rows, traces).mapInArrow(run, f"conv_id {kind.simpleString()}, repaired_sha256 string")


def repair(rows: DataFrame, size: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, chunks, traces) of the rows, from which ``faults``, ``audits``, ``repaired`` and ``hashes`` are read."""
    rows = tidy(rows)
    c = cells(rows)
    parts = chunks(c, size)
    return c, parts, traces(parts)


# ------------------------------------------------------------------ the query

def damage(rows: DataFrame) -> DataFrame:
    """The damage of the contract: by ``crc32("conv_id:turn") % 20`` a row goes (0), loses its text (1) or its sentence ends (2),
    is repeated (3) or becomes the user's (4)."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    d = tidy(rows).withColumn("fault", F.crc32(F.concat(text[0], F.lit(":"), text[1]).cast("binary")) % 20).where("fault <> 0")
    f = F.col("fault")
    new = F.when(f == 1, F.lit("")).when(f == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return d.select("conv_id", "turn", F.when(f == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), new.alias("text"),
                    F.explode(F.array_repeat(F.lit(0), F.when(f == 3, 2).otherwise(1))).alias("n_")).drop("n_")


def digest(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """The counts, the audit and the hash of every conversation of ``rows`` after its damage."""
    hurt = damage(rows)
    c, parts, told = repair(hurt, size)
    out = rows.select("conv_id").distinct()
    for k, d in enumerate((faults(c), audits(parts, told), hashes(hurt, told))):
        d = d.withColumnRenamed("conv_id", f"c{k}")
        out = out.join(d, out.conv_id.eqNullSafe(d[f"c{k}"]), "left").drop(f"c{k}")
    empty = hashlib.sha256(b"").hexdigest()
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
