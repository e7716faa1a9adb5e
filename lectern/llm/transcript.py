"""Chat formatting: who says what in a transcript, by a hidden Markov model, and its canonical rendering.

Each role has two hidden states: the first line of its turn, and a further line. So a line without a marker says little
inside a turn, whoever speaks, and only that a turn goes on more likely than a new one begins. A line of a transcript
(``lines`` gives a row for each) is observed through its speaker marker ("User:", "[Assistant]", "Speaker 2:"), its
length, whether it asks, and whether it looks like a list or code. Start, transition and emission probabilities are
smoothed counts over labelled lines, taken in Spark; without labels the pseudo-counts alone remain, which tie markers to
roles and let user and assistant alternate.

Viterbi's best path is a product of matrices over (max, +), so a long conversation needn't be in one task. Lines are
dealt in order to blocks. Where a conversation crosses blocks, each block gives the best scores from its first to its
last state; chaining these few matrices fixes the states at the blocks' edges, and every block is then decoded alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written

ROLES = ("system", "user", "assistant", "tool")
#: What a marker may say, by class; class 0 is no marker, the last two are other numbered speakers (odd, even).
MARKERS = (("system", "instructions"), ("user", "human", "customer", "client", "question", "q"), ("assistant", "ai", "bot", "agent", "answer", "a"), ("tool", "function", "observation"))
#: Values of each feature of a line: marker class, length class, asks, list or code.
SIZES = (len(MARKERS) + 3, 12, 2, 2)
#: Lines in a block.
BLOCK = 4096
OPEN, CLOSE = "<|{role}|>\n", "\n<|end|>\n"

_MARK = r"(?i)^\s*[\[(<*#_]*\s*({words}|speaker)[ _]*(\d*)\s*[\])>*_]*\s*(?::|\]|>)\s*[*_]*\s*"


def marker_pattern() -> str:
    words = sorted((w for ws in MARKERS for w in ws), key=len, reverse=True)
    return _MARK.format(words="|".join(words))


def features(text: Column) -> list[Column]:
    """The features of a line, each from 0 to its size."""
    body = F.coalesce(text, F.lit(""))
    word, number = F.lower(F.regexp_extract(body, marker_pattern(), 1)), F.regexp_extract(body, marker_pattern(), 2)
    marker = F.lit(0)
    for k, words in enumerate(MARKERS):
        marker = F.when(word.isin(*words), k + 1).otherwise(marker)
    odd = F.coalesce(F.substring(number, -1, 1).try_cast("int") % 2, F.lit(1)) == 1
    marker = F.when(word == "speaker", F.when(odd, SIZES[0] - 2).otherwise(SIZES[0] - 1)).otherwise(marker)
    length = F.least(F.lit(SIZES[1] - 1), F.floor(F.log2(F.length(body) + F.lit(1)))).cast("int")
    asks = F.rtrim(body).endswith("?").cast("int")
    listed = F.regexp_like(body, F.lit(r"(?m)^\s*(?:[-*+•]|\d+[.)])\s|```")).cast("int")
    return [marker.cast("int"), length, asks, listed]


class Model(NamedTuple):
    """Log probabilities: start (state), transition (state, next state), emission of each feature (state, value).

    State 2 * k is the first line of a turn of role k, state 2 * k + 1 a further one.
    """

    start: np.ndarray
    move: np.ndarray
    emit: tuple[np.ndarray, ...]


def _pseudo() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    n = len(ROLES)
    start, move = np.zeros(2 * n), np.zeros((2 * n, 2 * n))
    start[::2] = 1.0, 1.0, 0.2, 0.05
    next_role = np.full((n, n), 0.1)
    next_role[1, 2] = next_role[2, 1] = next_role[0, 1] = next_role[3, 2] = 1.0
    move[::2, ::2] = move[1::2, ::2] = next_role
    for k in range(n):  # only its own turn goes on
        move[2 * k : 2 * k + 2, 2 * k + 1] = 1.0
    emit = [np.full((2 * n, size), 0.5) for size in SIZES]
    for k in range(n):
        emit[0][2 * k, k + 1] += 20
        emit[0][2 * k + 1, 0] += 20
    emit[0][2, SIZES[0] - 2] += 5
    emit[0][4, SIZES[0] - 1] += 5
    return start, move, emit


def trained(turns: DataFrame, conversation: str = "conv_id", position: str = "turn", text: str = "text", role: str = "role") -> Model:
    """The model of labelled turns (numbered in sequence): counts of states, of pairs of successive ones, of lines' features.

    Roles beside ROLES, and null ones, are left out. Only counts reach the driver: at most states times features' values.
    """
    start, move, emit = _pseudo()
    number = {r: 2 * k for k, r in enumerate(ROLES)}
    known = turns.select(F.col(conversation).alias("c"), F.col(position).cast("long").alias("p"), F.lower(role).alias("r"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"))
    known = known.filter(F.col("r").isin(*ROLES)).withColumn("goes_on", (F.size("lines") > 1).cast("int"))
    observed = known.select("r", F.posexplode("lines").alias("at", "line"))
    observed = observed.select("r", F.least("at", F.lit(1)).alias("further"), *[f.alias(f"f{k}") for k, f in enumerate(features(F.col("line")))])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"f{k}").alias("v")) for k in range(len(SIZES))])).alias("f")
    for r in observed.select("r", "further", pairs).groupBy("r", "further", "f.k", "f.v").count().collect():
        emit[r["k"]][number[r["r"]] + r["further"], r["v"]] += r["count"]
    for r in known.groupBy("r").agg(F.sum("goes_on").alias("begun"), F.sum(F.size("lines") - 1 - F.col("goes_on")).alias("more")).collect():
        k = number[r["r"]]
        move[k, k + 1] += r["begun"]
        move[k + 1, k + 1] += r["more"]
    after = known.select("c", (F.col("p") - 1).alias("p"), F.col("r").alias("s"))
    for r in known.select("c", "p", "r", "goes_on").join(after, ["c", "p"]).groupBy("r", "goes_on", "s").count().collect():
        move[number[r["r"]] + r["goes_on"], number[r["s"]]] += r["count"]
    before = known.select("c", (F.col("p") + 1).alias("p"))
    for r in known.select("c", "p", "r").join(before, ["c", "p"], "left_anti").groupBy("r").count().collect():
        start[number[r["r"]]] += r["count"]
    with np.errstate(divide="ignore"):  # what can't follow keeps the logarithm of 0
        share = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        return Model(share(start), share(move), tuple(map(share, emit)))


def emissions(model: Model, observed: np.ndarray) -> np.ndarray:
    """Log probabilities (line, state) of observed features (line, feature)."""
    return sum(e[:, observed[:, k]] for k, e in enumerate(model.emit)).T


def transfer(model: Model, emitted: np.ndarray) -> np.ndarray:
    """Best scores from each first state to each last one over the lines, their emissions included."""
    m = np.full((len(model.start), len(model.start)), -np.inf)
    np.fill_diagonal(m, emitted[0])
    for e in emitted[1:]:
        m = (m[:, :, None] + model.move[None]).max(axis=1) + e
    return m


def viterbi(model: Model, emitted: np.ndarray, first: int = -1, last: int = -1) -> np.ndarray:
    """The best states; the first and the last one may be given. Of equal paths the one with earlier states counts."""
    n, states = len(emitted), len(model.start)
    score = (model.start if first < 0 else np.where(np.arange(states) == first, 0.0, -np.inf)) + emitted[0]
    back = np.zeros((n, states), np.int64)
    for k in range(1, n):
        reach = score[:, None] + model.move
        back[k] = reach.argmax(axis=0)
        score = reach.max(axis=0) + emitted[k]
    path = np.zeros(n, np.int64)
    path[-1] = int(score.argmax()) if last < 0 else last
    for k in range(n - 1, 0, -1):
        path[k - 1] = back[k, path[k]]
    return path


def _runs(names: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(names)]))


def parsed(lines: DataFrame, model: Model, conversation: str = "conv_id", position: str = "turn", text: str = "text") -> DataFrame:
    """Each line with its recovered role: ``conversation, position``, ``role``, ``starts_turn``, ``ends_turn``, ``rendered``.

    A turn is a run of lines of one role. ``rendered`` is the line without its marker, after the role's opening mark if
    it starts a turn, before the closing mark if it ends one; a conversation's pieces in order are its canonical form.
    Lines are ordered by position (null first), then by a hash of their text. Null conversations form
    one; null texts are empty lines; repeated lines stay. An empty table gives an empty result. Columns that the
    caller's table has besides don't matter.
    """
    spark = lines.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kind = dict(lines.dtypes)
    named = lines.select(
        F.coalesce(F.concat(F.lit("c"), F.col(conversation).cast("string")), F.lit("null")).alias("name"),
        F.col(conversation).alias("c"),
        F.col(position).alias("p"),
        F.coalesce(F.col(text), F.lit("")).alias("t"),
        F.array(*features(F.col(text))).alias("f"),
    ).withColumn("h", F.xxhash64("t"))
    order = ["name", F.col("p").asc_nulls_first(), "h"]
    dealt = named.repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = seen + np.arange(batch.num_rows)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array((np.int64(part) << 32) + at // BLOCK), pa.array(at % BLOCK)], ["name", "c", "p", "t", "f", "block", "seq"])

    schema = f"name string, c {kind[conversation]}, p {kind[position]}, t string, f array<int>, block long, seq long"
    blocks = written(dealt.mapInArrow(number, schema), "transcript-blocks")

    def edges(key: tuple, pdf):
        import pandas as pd

        pdf = pdf.sort_values("seq")
        names = np.array(pdf["name"].tolist(), object)
        runs = _runs(names)
        rows = []
        for a, b in {runs[0], runs[-1]}:
            emitted = emissions(sent.value, np.stack(pdf["f"].iloc[a:b].to_list()))
            rows.append({"name": names[a], "block": key[0], "matrix": transfer(sent.value, emitted).ravel().tolist()})
        return pd.DataFrame(rows, dtype=object)

    def chain(key: tuple, pdf):
        import pandas as pd

        out = {"block": [], "of": [], "first": [], "last": [], "before": [], "after": []}
        if len(pdf) > 1:
            pdf = pdf.sort_values("block")
            model, n = sent.value, len(sent.value.start)
            matrices = np.stack(pdf["matrix"].to_list()).reshape(-1, n, n)
            score, froms, entries = model.start, [], []
            for k, m in enumerate(matrices):
                if k:
                    reach = score[:, None] + model.move
                    froms.append(reach.argmax(axis=0))
                    score = reach.max(axis=0)
                total = score[:, None] + m
                entries.append(total.argmax(axis=0))
                score = total.max(axis=0)
            last = int(score.argmax())
            path = []
            for k in range(len(matrices) - 1, -1, -1):
                first = int(entries[k][last])
                path.append((first, last))
                if k:
                    last = int(froms[k - 1][first])
            path.reverse()
            out = {
                "block": pdf["block"].tolist(),
                "of": [key[0]] * len(path),
                "first": [f for f, _ in path],
                "last": [x for _, x in path],
                "before": [-1, *[x for _, x in path[:-1]]],
                "after": [*[f for f, _ in path[1:]], -1],
            }
        return pd.DataFrame(out, dtype=object)

    matrices = blocks.select("name", "f", "block", "seq").groupBy("block").applyInPandas(edges, "name string, block long, matrix array<double>")
    fixed = written(matrices.groupBy("name").applyInPandas(chain, "block long, of string, first long, last long, before long, after long"), "transcript-edges")

    def decode(pdf, given):
        import pandas as pd

        names = pdf["name"].to_numpy() if len(pdf) else np.zeros(0, object)
        if not len(names):
            return pd.DataFrame({"c": [], "p": [], "t": [], "role": [], "starts": [], "ends": []}, dtype=object)
        pdf = pdf.sort_values("seq")
        names = np.array(pdf["name"].tolist(), object)
        known = {r.of: r for r in given.itertuples()}
        roles, starts, ends = np.zeros(len(pdf), np.int64), np.ones(len(pdf), bool), np.ones(len(pdf), bool)
        for a, b in _runs(names):
            g = known.get(names[a])
            emitted = emissions(sent.value, np.stack(pdf["f"].iloc[a:b].to_list()))
            path = roles[a:b] = viterbi(sent.value, emitted, g.first if g else -1, g.last if g else -1) // 2
            change = path[1:] != path[:-1]
            starts[a + 1 : b], ends[a : b - 1] = change, change
            if g:
                starts[a], ends[b - 1] = g.before // 2 != path[0], g.after // 2 != path[-1]
        return pd.DataFrame({"c": pdf["c"].tolist(), "p": pdf["p"].tolist(), "t": pdf["t"].tolist(), "role": [ROLES[k] for k in roles], "starts": starts.tolist(), "ends": ends.tolist()}, dtype=object)

    out = blocks.groupBy("block").cogroup(fixed.groupBy("block")).applyInPandas(decode, f"c {kind[conversation]}, p {kind[position]}, t string, role string, starts boolean, ends boolean")
    body = F.regexp_replace("t", marker_pattern(), "")
    opening = F.concat(F.lit(OPEN.split("{role}")[0]), F.col("role"), F.lit(OPEN.split("{role}")[1]))
    rendered = F.concat(F.when(F.col("starts"), opening).otherwise(F.lit("\n")), body, F.when(F.col("ends"), F.lit(CLOSE)).otherwise(F.lit("")))
    return out.select(F.col("c").alias(conversation), F.col("p").alias(position), "role", F.col("starts").alias("starts_turn"), F.col("ends").alias("ends_turn"), rendered.alias("rendered"))


def lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The lines of raw transcripts: ``doc_id, position, text``; a null text has none."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("position", "text"))


#: Ways to mark who speaks, for the roles in order.
STYLES = (
    ("System: ", "User: ", "Assistant: ", "Tool: "),
    ("[System] ", "[Human] ", "[AI] ", "[Function] "),
    ("**System:** ", "**Customer:** ", "**Agent:** ", "**Tool:** "),
    ("### Instructions: ", "### Question: ", "### Answer: ", "### Observation: "),
    ("<system> ", "<user> ", "<bot> ", "<tool> "),
    ("", "Speaker 1: ", "Speaker 2: ", ""),
)
#: One turn in so many bears no marker.
BARE = 5


def marked(turns: DataFrame, conversation: str = "conv_id", position: str = "turn", text: str = "text", role: str = "role") -> DataFrame:
    """``turns`` as their raw transcript has them: each text after its speaker's marker.

    A conversation keeps to one style, chosen by a hash of its id; turns without a known role, and one in BARE by a
    hash of id and number, stand bare.
    """
    style = F.pmod(F.xxhash64(F.col(conversation), F.lit("style")), F.lit(len(STYLES)))
    at = F.array_position(F.array(*map(F.lit, ROLES)), F.lower(role))
    mark = F.try_element_at(F.try_element_at(F.array(*[F.array(*map(F.lit, s)) for s in STYLES]), (style + 1).cast("int")), F.nullif(at, F.lit(0)).cast("int"))
    bare = F.pmod(F.xxhash64(F.col(conversation), F.col(position), F.lit("bare")), F.lit(BARE)) == 0
    return turns.withColumn(text, F.concat(F.when(bare, F.lit("")).otherwise(F.coalesce(mark, F.lit(""))), F.coalesce(F.col(text), F.lit(""))))


def recovered(turns: DataFrame, model: Model, conversation: str = "conv_id", position: str = "turn", text: str = "text") -> DataFrame:
    """``parsed`` for every line of ``turns``, whose texts may hold several: with ``position`` (of the turn) and ``line``."""
    each = turns.select(F.col(conversation).alias("c"), F.col(position).cast("long").alias("p"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "text"))
    each = each.select("c", (F.shiftleft("p", 32) + F.col("line")).alias("place"), "text")
    out = parsed(each, model, "c", "place", "text")
    return out.select(F.col("c").alias(conversation), F.shiftright("place", 32).alias(position), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("line"), "role", "starts_turn", "ends_turn", "rendered")
