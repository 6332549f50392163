"""Folding, background energies and shuffled controls as Spark operators.

Sequences and blocks are dealt evenly over tasks and folded in batches of one
width; what leaves a task is one row for each that came in.  Nothing is
shuffled but to even out the work, and nothing comes to the driver.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.energy import energies
from ..functions.folding import Fold, Room, dot_bracket
from .blocks import remove_common_gaps

#: Cells (width squared of each alignment) that one batch may fill.
BATCH_CELLS = 2_000_000
FOLDED = "mfe double, structure string"
CONSENSUS = "consensus_mfe double, energy_part double, covariance_part double, structure string, n_pairs int, combinations double"


def in_batches(widths: list[int], rows: list[int], copies: int = 1):
    """Indices of items of as many rows and of nearly one width together, the widest first, few enough for BATCH_CELLS with ``copies`` of each."""
    alike = defaultdict(list)
    for i, r in enumerate(rows):
        alike[r].append(i)
    for found in alike.values():
        group: list[int] = []
        for i in sorted(found, key=lambda i: -widths[i]):
            if group and ((len(group) + 1) * copies * widths[group[0]]**2 > BATCH_CELLS or 4 * widths[i] < 3 * widths[group[0]]):
                yield group
                group = []
            group.append(i)
        yield group


def fold_udf(parameters: str = ""):
    """A function of an ungapped sequence: its least energy and a structure that has it; null stays null."""
    @F.pandas_udf(FOLDED)
    def fold(seqs: pd.Series) -> pd.DataFrame:
        got: list = [(None, None) if s is None else (0.0, "") for s in seqs]
        known, room = [i for i, s in enumerate(seqs) if s], Room()
        for group in in_batches([len(seqs[i]) for i in known], [1] * len(known)):
            at = [known[g] for g in group]
            folded = Fold([[seqs[i]] for i in at], energies(parameters), room=room)
            for k, (i, mfe) in enumerate(zip(at, folded.energy())):
                got[i] = (float(mfe), dot_bracket(len(seqs[i]), folded.pairs(k)))
        return pd.DataFrame(got, columns=["mfe", "structure"])

    return fold


def fold_mfe(df: DataFrame, seq: Column, *, parameters: str = "") -> DataFrame:
    """``df`` with ``mfe`` and ``structure`` of an RNA sequence (upper case, no gaps)."""
    return df.withColumn("_f", fold_udf(parameters)(seq)).select(*df.columns, "_f.mfe", "_f.structure")


def consensus_udf(parameters: str = ""):
    """A function of an alignment's rows: consensus energy, its parts, structure and pair types per pair."""
    @F.pandas_udf(CONSENSUS)
    def consensus(blocks: pd.Series) -> pd.DataFrame:
        got: list = [(None,) * 6] * len(blocks)
        known, room = [i for i, b in enumerate(blocks) if b is not None and len(b) and len(b[0])], Room()
        for group in in_batches([len(blocks[i][0]) for i in known], [len(blocks[i]) for i in known]):
            at = [known[g] for g in group]
            rows = [list(blocks[i]) for i in at]
            folded = Fold(rows, energies(parameters), consensus=True, room=room)
            for k, (i, mfe) in enumerate(zip(at, folded.energy())):
                pairs = folded.pairs(k)
                bonus = -sum(folded.scores_of(k, pairs)) / (100.0 * folded.s)
                got[i] = (float(mfe), float(mfe) - bonus, bonus, dot_bracket(len(rows[k][0]), pairs), len(pairs), combinations(folded.codes[:, :, k], pairs))
        return pd.DataFrame(got, columns=["consensus_mfe", "energy_part", "covariance_part", "structure", "n_pairs", "combinations"])

    return consensus


def combinations(codes: np.ndarray, pairs: list[tuple[int, int]]) -> float:
    """Different pairing combinations of bases for each consensus pair, on average; 0 without pairs."""
    rows = codes.tolist()
    # two bases pair if their codes add up to 5 or 7
    kinds = sum(len({(r[i], r[j]) for r in rows if r[i] + r[j] in (5, 7)}) for i, j in pairs)
    return kinds / len(pairs) if pairs else 0.0


def consensus_fold(blocks: DataFrame, rows: Column, *, parameters: str = "") -> DataFrame:
    """``blocks`` with the consensus fold of ``rows``, an array of equally long gapped sequences."""
    return blocks.withColumn("_f", consensus_udf(parameters)(rows)).select(*blocks.columns, "_f.*")


def shuffled_pairs(seq: str, rng: np.random.Generator) -> str:
    """A random sequence with the same first and last base and the same count of every pair of neighbours.

    A sequence is a walk that uses each step between bases once.  The last step
    out of each base is drawn until these lead to the end from everywhere; any
    order of the other steps then completes the walk.
    """
    if len(seq) < 4:
        return seq
    steps = defaultdict(list)
    for a, b in zip(seq, seq[1:]):
        steps[a].append(b)
    end = seq[-1]
    while True:
        last = {a: to[rng.integers(len(to))] for a, to in steps.items() if a != end}
        ends = {end}
        for _ in last:
            ends |= {a for a, b in last.items() if b in ends}
        if ends >= set(last):
            break
    order = {}
    for a, to in steps.items():
        rest = list(to)
        if a in last:
            rest.remove(last[a])
        rest = [rest[i] for i in rng.permutation(len(rest))]
        order[a] = iter(rest + ([last[a]] if a in last else []))
    out = [seq[0]]
    while (nxt := next(order.get(out[-1], iter(())), None)) is not None:
        out.append(nxt)
    return "".join(out)


def shuffled_bases(seq: str, rng: np.random.Generator) -> str:
    return "".join(rng.permutation(list(seq))) if seq else seq


def background_udf(samples: int, *, pairs: bool = True, parameters: str = ""):
    """A function of a sequence: mean and standard deviation of the energies of its shuffles, seeded by the sequence."""
    shuffle = shuffled_pairs if pairs else shuffled_bases

    @F.pandas_udf("mean_mfe double, sd_mfe double")
    def background(seqs: pd.Series) -> pd.DataFrame:
        out: list = [(None, None)] * len(seqs)
        known, room = [i for i, s in enumerate(seqs) if s], Room()
        for group in in_batches([len(seqs[i]) for i in known], [1] * len(known), samples):
            drawn = []
            for i in group:
                rng = np.random.default_rng(zlib.crc32(seqs[known[i]].encode()))
                drawn += [[shuffle(seqs[known[i]], rng)] for _ in range(samples)]
            got = Fold(drawn, energies(parameters), room=room).energy().reshape(len(group), samples)
            for i, own in zip(group, got):
                out[known[i]] = (float(own.mean()), float(own.std(ddof=1)))
        return pd.DataFrame(out, columns=["mean_mfe", "sd_mfe"])

    return background


def z_scores(df: DataFrame, seq: Column, *, samples: int = 200, pairs: bool = True, parameters: str = "") -> DataFrame:
    """``df`` with ``mfe, mean_mfe, sd_mfe, z``: how many deviations the sequence lies from its shuffles; 0 where they don't differ."""
    folded = fold_mfe(df, seq, parameters=parameters).drop("structure")
    both = folded.withColumn("_b", background_udf(samples, pairs=pairs, parameters=parameters)(seq)).select(*folded.columns, "_b.*")
    return both.withColumn("z", F.when(F.col("sd_mfe") < 1e-5, 0.0).otherwise((F.col("mfe") - F.col("mean_mfe")) / F.col("sd_mfe")))


def shuffle_columns(columns: DataFrame, *, level: int = 2, seed: int = 1) -> DataFrame:
    """A control alignment: columns change places with others of their kind.

    ``columns`` has ``block_id, col, letters`` (the column from top to bottom).
    Kinds by level: 0 all alike, 1 the same gaps, 2 the same gaps and the
    same tenth of identical pairs.  Gives ``block_id, col, letters, from_col``.
    """
    letters = F.col("letters")

    def count(x: str) -> Column:
        return F.length(letters) - F.length(F.replace(letters, F.lit(x)))

    equal = sum((count(x) * (count(x) - 1) for x in "ACGU-"), F.lit(0))
    tenth = F.when(F.length(letters) > 1, F.floor((equal * 20 + F.length(letters) * (F.length(letters) - 1)) / (2 * F.length(letters) * (F.length(letters) - 1)))).otherwise(0)
    kind = [F.lit(""), F.regexp_replace(letters, "[^-]", "N"), F.concat_ws(":", F.regexp_replace(letters, "[^-]", "N"), tenth.cast("string"))][level]
    from pyspark.sql import Window

    w = Window.partitionBy("block_id", "kind")
    mixed = F.md5(F.concat_ws(":", F.lit(seed), F.col("block_id"), F.col("col")))
    ranked = columns.withColumn("kind", kind).withColumn("place", F.row_number().over(w.orderBy("col"))).withColumn(
        "drawn", F.row_number().over(w.orderBy(mixed, "col")))
    to = ranked.select("block_id", "kind", F.col("place").alias("rank"), "col")
    what = ranked.select("block_id", "kind", F.col("drawn").alias("rank"), F.col("col").alias("from_col"), "letters")
    return to.join(what, ["block_id", "kind", "rank"]).select("block_id", "col", "letters", "from_col")


def shuffled_block(block_id: int, seqs: list[str], *, level: int = 2, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells by column, places, columns that move there) of one block: :func:`shuffle_columns` within it."""
    cells = np.stack([np.frombuffer(s.upper().replace("T", "U").encode("latin-1", "replace"), np.uint8) for s in seqs]).T
    n, width = cells.shape[1], len(cells)
    gaps = cells == ord("-")
    counts = [(cells == ord(x)).sum(1).astype(np.int64) for x in "ACGU-"]
    equal = sum(c * (c - 1) for c in counts)
    tenth = (equal * 20 + n * (n - 1)) // (2 * n * (n - 1)) if n > 1 else np.zeros(width, np.int64)
    marks = np.packbits(gaps, axis=1) if level else np.zeros((width, 1), np.uint8)
    kinds = np.unique(np.column_stack([marks, tenth.astype(np.uint8) if level > 1 else np.zeros(width, np.uint8)]), axis=0, return_inverse=True)[1].ravel()
    drawn = np.array([hashlib.md5(f"{seed}:{block_id}:{c}".encode()).hexdigest() for c in range(width)])
    columns = np.arange(width)
    # of each kind, the k-th place takes the k-th column drawn
    return cells, np.lexsort((columns, kinds)), np.lexsort((columns, drawn, kinds))


def shuffle_blocks(blocks: DataFrame, *, level: int = 2, seed: int = 1) -> DataFrame:
    """The same control for whole blocks (``block_id``, ``rows`` with ``seq``, all of one width), each worked on where it is: no exchange.

    Gives ``block_id, col, letters, from_col``.  A block's columns fit in one
    task, as its rows do; what leaves it comes in slices.
    """
    def run(batches):
        for b in batches:
            for block_id, seqs in zip(b.column("block_id").to_pylist(), b.column("seqs").to_pylist()):
                if not seqs or not seqs[0]:
                    continue
                cells, places, columns = shuffled_block(block_id, seqs, level=level, seed=seed)
                for lo in range(0, len(places), 100_000):
                    to, what = places[lo:lo + 100_000], columns[lo:lo + 100_000]
                    letters = [cells[c].tobytes().decode("latin-1") for c in what]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(to), block_id)), pa.array(to), pa.array(letters, pa.string()), pa.array(what)], ["block_id", "col", "letters", "from_col"])

    rows = blocks.select(F.col("block_id").cast("long").alias("block_id"), F.transform("rows", lambda r: r["seq"]).alias("seqs"))
    return rows.mapInArrow(run, "block_id long, col long, letters string, from_col long")


def identities(rows: list[str]) -> np.ndarray:
    """Share of equal letters of every two rows, columns in which both have a gap left out."""
    codes = np.stack([np.frombuffer(r.upper().encode(), np.uint8) for r in rows])
    shown = (codes[:, None] != ord("-")) | (codes[None] != ord("-"))
    return ((codes[:, None] == codes[None]) & shown).sum(2) / np.maximum(1, shown.sum(2))


def farthest(same: np.ndarray, left: list[int], best: float) -> int:
    """Of ``left`` but its first, the row whose identities with the others lie furthest from ``best``."""
    costs = [((same[i, left] - best) ** 2).sum() - (same[i, i] - best) ** 2 for i in left[1:]]
    return left[1 + int(np.argmax(costs))]


def samples_of_rows(rows: list[str], samples: int, *, most: int, least: int, best: float, alike: float, seed: int) -> list[list[int]]:
    """Indices of ``samples`` choices of rows, the first row in each; later choices avoid rows that earlier ones took."""
    same, used = identities(rows), np.zeros(len(rows))
    rng, out = np.random.default_rng(seed), []
    for number in range(samples):
        left = list(range(len(rows)))
        for i, j in [(i, j) for i in left for j in left if i < j and same[i, j] > alike]:
            if i in left and j in left and len(left) > least:
                # of two alike, rather the one that has been taken before
                earlier = i > 0 and rng.random() * (used[i] + used[j]) < used[i]
                left.remove(i if earlier else j)
        for _ in range((len(left) - most) // 2 if number else 0):
            weights = used[left[1:]]
            if weights.sum() > 0:
                left.remove(int(rng.choice(left[1:], p=weights / weights.sum())))
        while len(left) > most:
            left.remove(farthest(same, left, best))
        used[left] += 1
        out.append(left)
    return out


def sample_rows(blocks: DataFrame, *, samples: int = 1, most: int = 6, least: int = 2, best: float = 0.8, alike: float = 0.95) -> DataFrame:
    """``samples`` choices of rows of every block, each a block with ``sample_no`` (from 1) and without columns of gaps alone.

    Of two rows more than ``alike`` identical one goes while more than
    ``least`` are left; then, while more than ``most`` are left, the one whose
    identities lie furthest from ``best``.  Choices after the first drop rows
    taken before with a chance by how often they were.  The first row stays
    in each.  Draws are seeded by the rows, so reruns agree.  Blocks without
    rows go.
    """
    @F.pandas_udf("array<array<int>>")
    def chosen(rows: pd.Series) -> pd.Series:
        return pd.Series([samples_of_rows(list(r), samples, most=most, least=least, best=best, alike=alike, seed=zlib.crc32("\n".join(r).encode())) for r in rows])

    each = blocks.where(F.size("rows") > 0).withColumn("_chosen", chosen(F.transform("rows", lambda r: r["seq"])))
    each = each.select("*", F.posexplode("_chosen").alias("_no", "_kept")).withColumn("sample_no", F.col("_no") + 1)
    cut = each.withColumn("rows", F.transform("_kept", lambda i: F.get("rows", i))).drop("_chosen", "_no", "_kept")
    return remove_common_gaps(cut)


def select_rows_udf(*, most: int = 6, best: float = 0.8, alike: float = 0.95):
    """A function of an alignment's rows: indices of those to keep, the first always among them.

    Of two rows more than ``alike`` identical the later goes; then, while more
    than ``most`` are left, the one whose identities lie furthest from ``best``.
    """
    @F.pandas_udf("array<int>")
    def select(blocks: pd.Series) -> pd.Series:
        def one(rows):
            same, left = identities(rows), []
            for i in range(len(rows)):
                if all(same[i, j] <= alike for j in left):
                    left.append(i)
            while len(left) > most:
                left.remove(farthest(same, left, best))
            return left

        return pd.Series([None if b is None or not len(b) else one(list(b)) for b in blocks])

    return select
