"""Cheapest repair of conversations whose turns are faulty or out of order.

A conversation is good if it is empty or reads, by the initials of its roles,
an optional system turn and then user and assistant in turn: ``(s?(ua)+)?``.
Each turn is kept (K, free), gets another role (R, 2) or is deleted (D, 3; blank
and duplicate turns must be), a turn without text is inserted anywhere (I, 2),
and a truncated turn that stays costs 1.

What the repair depends on is a conversation's signature: one letter per turn
for its role and fault.  Signatures are sorted and read as the paths of a
prefix trie: the layers of the dynamic programme along the current path are a
stack, the next signature goes on from the last layer it shares with the one
before, and a signature seen before costs nothing.  A layer is, for each state
of the pattern, the cost, the rank of its edits among those of all states and a
step back, so a path of n turns takes memory for n small layers.  Signatures are
dealt out by ranges of (signature, conversation), so one that a third of all
conversations share lies in several tasks, each of which computes it once.

Turns are shuffled twice: narrow rows (roles, faults, a hash of the text) give
the signatures; at the end texts meet their conversation's edits in one sorted
stream, from which the repaired text is hashed turn by turn, so no
conversation's text is held in memory.

Defined results: a null role or text is one space, so it is blank or of no
known role; turns go by number, null first, turns of one number by role and
then by a hash of the text; a null conversation id is a conversation of its
own; a role's initial is its first character; an empty role has none and can't be kept; a
conversation without turns needs no edit; equal turns are duplicates of the
first; an empty table gives no row; texts of any length are read whole; other
columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SOLID = r"[^\x20\x09-\x0D]"
#: Signature letters: a turn that must go, and (initial, truncated) of the others; ``o`` is any other initial.
GONE = "x"
LETTERS = {("s", False): "s", ("u", False): "u", ("a", False): "a", ("o", False): "o", ("s", True): "S", ("u", True): "U", ("a", True): "A", ("o", True): "O"}
#: States: nothing yet, after system, after user, after assistant; the role each must go on with, and the state it leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}

Layer = list  #: per state: None, or (cost, rank, state before, inserts before the letter, letter)


def _choices(layer: Layer) -> list[tuple[int, int, int, int, int]]:
    """(state, cost, rank, state before, inserts): where 0 to 3 inserted turns lead from each state."""
    out = []
    for before, held in enumerate(layer):
        if held is not None:
            state, cost = before, held[0]
            for inserts in range(4):  # more would come back to a state it was in
                out.append((state, cost, held[1], before, inserts))
                state, cost = NEXT[state][1], cost + INSERT
    return out


def step(layer: Layer, letter: str) -> Layer:
    """The layer after one more turn."""
    best: Layer = [None] * 4
    for state, cost, rank, before, inserts in _choices(layer):
        moves = [("D", state, DELETE)]
        if letter != GONE:
            fault = TRUNCATED if letter.isupper() else 0
            role, to = NEXT[state]
            if letter.lower() == role:
                moves.append(("K", to, KEEP + fault))
            else:
                moves.append(("R", to, REROLE + fault))
                if letter.lower() == "s" and state == START:
                    moves.append(("K", SYSTEM, KEEP + fault))
        for edit, to, price in moves:
            # edits up to a turn are no prefix of one another, so ranks and what follows decide ties
            key = (cost + price, rank, "I" * inserts + edit)
            if best[to] is None or key < best[to][0]:
                best[to] = (key, before, inserts, edit)
    order = sorted((b[0][1:], s) for s, b in enumerate(best) if b is not None)
    ranks = {s: r for r, (_, s) in enumerate(order)}
    return [None if b is None else (b[0][0], ranks[s], b[1], b[2], b[3]) for s, b in enumerate(best)]


FIRST: Layer = [(0, 0, START, 0, ""), None, None, None]


def answer(layers: list[Layer]) -> tuple[int, str]:
    """Least cost and the ASCII-least edits of the path whose layers these are."""
    cost, _, _, before, inserts = min((c, r, i, b, i) for s, c, r, b, i in _choices(layers[-1]) if s == ASSISTANT or (s == START and i == 0))
    parts, state = ["I" * inserts], before
    for layer in reversed(layers[1:]):
        _, _, before, inserts, edit = layer[state]
        parts.append("I" * inserts + edit)
        state = before
    return cost, "".join(reversed(parts))


class Trie:
    """The path of the signature at hand: its letters and layers."""

    def __init__(self):
        self.letters, self.layers = "", [FIRST]
        self.found: tuple[int, str] = answer(self.layers)
        self.steps = 0  #: layers computed so far

    def solve(self, signature: str) -> tuple[int, str]:
        if signature == self.letters:
            return self.found
        shared = 0
        for a, b in zip(signature, self.letters):
            if a != b:
                break
            shared += 1
        del self.layers[shared + 1 :]
        for letter in signature[shared:]:
            self.layers.append(step(self.layers[-1], letter))
        self.steps += len(signature) - shared
        self.letters, self.found = signature, answer(self.layers)
        return self.found


def _ordered() -> list[Column]:
    """The order of a conversation's turns."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("_hash"), F.col("copy")]


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, letter, pair_ok, fault, pos) of each turn: narrow rows."""
    solid = F.regexp_extract("text", r"(?s)^.*([^\x20\x09-\x0D])", 1)
    narrow = rows.select(
        "conv_id", "turn", "role", "copy", "_hash", F.sha2(F.concat_ws("\u0001", F.length("role").cast("string"), "role", "text"), 256).alias("same"), F.when(F.length("text") == 0, "").otherwise(solid).alias("last")
    )
    by = Window.partitionBy("conv_id")
    in_order = by.orderBy(*_ordered())
    first = F.substring("role", 1, 1)
    out = narrow.withColumn("again", F.row_number().over(Window.partitionBy("conv_id", "same").orderBy(*_ordered())) > 1)
    fault = F.when(F.col("last") == "", "blank").when(F.col("again"), "duplicate").when(~F.col("last").isin(*".!?"), "truncated")
    known = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return (
        out.withColumn("fault", fault)
        .withColumns({"letter": letter, "pos": F.row_number().over(in_order), "pair": F.concat(F.lag(first).over(in_order), first)})
        .select("conv_id", "turn", "letter", "pos", "fault", F.coalesce(~F.col("pair").isin("su", "ua", "au"), F.lit(False)).alias("bad_pair"))
    )


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature), one row per conversation: a letter per turn."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    listed = F.array_sort(F.collect_list(F.struct("pos", "letter")))
    return (
        faults(rows)
        .groupBy("conv_id")
        .agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
            *[count(F.col("fault") == n).alias(n) for n in ("blank", "duplicate", "truncated")],
            count(F.col("bad_pair")).alias("illegal"),
            F.array_join(F.transform(listed, lambda x: x["letter"]), "").alias("signature"),
        )
    )


def edits(signed: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and (signature, cost, audit) for rows with a signature, by one trie a task."""
    spark = signed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = signed.select(*keep, "signature").repartitionByRange(parts, "signature", keep[0]).sortWithinPartitions("signature")

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            found = [trie.solve(s) for s in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=[*batch.schema.names, "cost", "audit"])

    return dealt.mapInArrow(solved, dealt.select("*", F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit")).schema)


def repaired(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """The columns of ``answers`` (conv_id, audit, ...) and repaired_sha256, the hash of the repaired ``role:text`` lines."""
    extra = [c for c in answers.columns if c not in ("conv_id", "audit")]
    kinds = dict(answers.dtypes)
    # a conversation's edits come before its turns in the sorted stream
    head = answers.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit(0).cast("bigint").alias("_hash"), F.lit(0).alias("copy"), F.col("audit").alias("text"), *extra)
    body = rows.select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("bigint").alias("turn"), "role", "_hash", "copy", "text", *[F.lit(None).cast(kinds[c]).alias(c) for c in extra])
    stream = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ordered())
    schema = answers.select("conv_id", "audit", *extra, F.lit("").alias("repaired_sha256")).schema

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        held: Line | None = None
        done: list[tuple] = []
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            heads = columns[1].to_pylist()
            roles, texts = columns[3].to_pylist(), columns[6].to_pylist()
            for i, kind in enumerate(heads):
                if kind == 0:
                    if held:
                        done.append(held.end())
                    held = Line(texts[i], [columns[0][i].as_py(), *[c[i].as_py() for c in columns[7:]]])
                else:
                    held.turn(roles[i], texts[i])
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
                done = []
        if held:
            done.append(held.end())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)

    return stream.mapInArrow(hashed, schema)


class Line:
    """One conversation's repair, turn by turn: its text is hashed as it comes."""

    ROLES = {"u": "user", "a": "assistant"}

    def __init__(self, audit: str, values: list):
        self.audit, self.values = audit, values
        self.place, self.state, self.hash, self.any = 0, START, hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def inserts(self) -> None:
        while self.audit[self.place : self.place + 1] == "I":
            role, self.state = NEXT[self.state]
            self.put(self.ROLES[role], "")
            self.place += 1

    def turn(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.place]
        self.place += 1
        if edit == "D":
            return
        if edit == "K" and role[:1] == "s":
            self.state = SYSTEM
        else:
            wanted, self.state = NEXT[self.state]
            role = role if edit == "K" else self.ROLES[wanted]
        self.put(role, text)

    def end(self) -> tuple:
        self.inserts()
        return self.values[0], self.audit, *self.values[1:], self.hash.hexdigest()


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, signature) of every conversation with a turn.

    ``rows``: conv_id, turn, role, text and, where turns of one number and role repeat, ``copy``.
    """
    if "copy" not in rows.columns:
        rows = rows.withColumn("copy", F.lit(0))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copy").withColumn("_hash", F.xxhash64("text"))
    signed = signatures(rows)
    found = edits(signed, ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal"])
    return repaired(rows, found).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "signature")


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy): turns of ``rows`` dropped, emptied, cut, repeated or given another role by a hash of id and turn; null is one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fate.alias("fate"))
        .where("fate <> 0")
        .select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    )


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """The repair of every conversation of ``rows`` after ``damage``; one that loses all its turns has zeros, no edits and the hash of the empty string."""
    out = repair(damage(rows))
    every = rows.select("conv_id").distinct()
    whole = every.withColumnRenamed("conv_id", "_c").join(out, F.col("_c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("_c", "conv_id")
    empty = {"audit": "", "signature": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return whole.select("conv_id", *[F.coalesce(F.col(c), F.lit(empty.get(c, 0)).cast(t)).alias(c) for c, t in out.dtypes if c != "conv_id"])


def oracle() -> str:
    """DuckDB SQL with the rows of ``op12_conversation_repair``: CRC-32 bit by bit, then the same states turn by turn, with whole edits as strings.

    Turns of one number go by role alone here, which is enough where a conversation has no two.
    """
    key = "list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint)"
    bit = "case when a & 1 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end"
    crc = f"xor(list_reduce(list_concat([4294967295::bigint], {key}), lambda acc, b: list_reduce(list_concat([xor(acc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda a, z: {bit})), 4294967295::bigint)"
    grown = lambda x, cost, edit: f"case when {x} is not null then {{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}'}} end"
    fault = f"(case when l between 'A' and 'Z' then {TRUNCATED} else 0 end)"
    move = lambda x, role: f"case when l = '{GONE}' then null when lower(l) = '{role}' then {grown(x, f'{KEEP} + {fault}', 'K')} else {grown(x, f'{REROLE} + {fault}', 'R')} end"
    state = "struct(c bigint, a varchar)"
    return f"""
    with recursive f as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc} % 20 as fate from conversations),
    r as (select conv_id, turn, copy, case when fate = 4 then 'user' else role end as role,
            case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
          from f join (values (0), (1)) c(copy) on copy = 0 or fate = 3 where fate <> 0),
    p as (select *, row_number() over w as pos, lag(left(role, 1)) over w || left(role, 1) as pair, regexp_extract(text, '(?s)^.*([^\\x20\\x09-\\x0D])', 1) as last,
            row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again from r window w as (partition by conv_id order by turn nulls first, role, copy)),
    q as (select *, case when last = '' then 'blank' when again then 'duplicate' when last not in ('.', '!', '?') then 'truncated' end as fault,
            case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'o' end as known from p),
    s as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
            count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal,
            string_agg(case when fault in ('blank', 'duplicate') then '{GONE}' when fault = 'truncated' then upper(known) else known end, '' order by pos) as sig,
            list(role order by pos) as roles, list(text order by pos) as texts from q group by conv_id),
    d(conv_id, i, l, b0, b1, b2, b3) as (
        select conv_id, 0::bigint, sig[1], {{'c': 0, 'a': ''}}::{state}, null::{state}, null::{state}, null::{state} from s
        union all
        select conv_id, i + 1, sig[i + 2], {grown('e0', DELETE, 'D')}, least({grown('e1', DELETE, 'D')}, case when lower(l) = 's' then {grown('e0', f'{KEEP} + {fault}', 'K')} end),
            least({grown('e2', DELETE, 'D')}, {move('e0', 'u')}, {move('e1', 'u')}, {move('e3', 'u')}), least({grown('e3', DELETE, 'D')}, {move('e2', 'a')})
        from (select *, least(b3, {grown('e2', INSERT, 'I')}) as e3 from
              (select d.*, sig, b0 as e0, b1 as e1, least(b2, {grown('b0', INSERT, 'I')}, {grown('b1', INSERT, 'I')}, {grown('b3', INSERT, 'I')}) as e2 from d join s using (conv_id) where i < length(sig)))),
    best as (select conv_id, least(b0, b3, {grown('u', INSERT, 'I')}) as e from
             (select d.*, least(b2, {grown('b0', INSERT, 'I')}, {grown('b1', INSERT, 'I')}, {grown('b3', INSERT, 'I')}) as u from d join s using (conv_id) where i = length(sig))),
    k as (select conv_id, e.c as cost, e.a as audit, unnest(range(1, length(e.a) + 1)) as place from best),
    m as (select *, audit[place] as edit, length(replace(audit[1:place], 'I', '')) as n, length(replace(audit[1:place], 'D', '')) as j from k),
    o as (select m.*, roles[n] as role, texts[n] as text, max(case when j = 1 and edit = 'K' and left(roles[n], 1) = 's' then 1 else 0 end) over (partition by m.conv_id) as led from m join s using (conv_id)),
    t as (select conv_id, string_agg((case when edit = 'K' then role when (j - led) % 2 = 1 then 'user' else 'assistant' end) || ':' || (case when edit = 'I' then '' else text end), chr(10) order by place) as whole from o where edit <> 'D' group by conv_id)
    select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
           coalesce(e.c, 0)::bigint as cost, coalesce(e.a, '') as audit, sha256(coalesce(whole, '')) as repaired_sha256, coalesce(sig, '') as signature
    from (select distinct conv_id from conversations) c left join s using (conv_id) left join best using (conv_id) left join t using (conv_id)"""
