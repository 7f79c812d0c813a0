"""Two runs against the same observations: alignment, bias angle, histograms, bootstrap."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from soundings.functions.scalars import QUANTILES, bias_angle, bin_centre, histogram_bin, ratio
from soundings.operators.quantiles import BINS, _bin, _locate, select_ranks
from soundings.session import cut_lineage

HALF_PI = math.pi / 2
PLACE = ("time", "lat", "lon")


def align_runs(first: DataFrame, second: DataFrame, variables, keys=("region", "season", *PLACE, "z"),
               order_by="profile_id") -> DataFrame:
    """Records both runs have, as ``<variable>_0`` and ``<variable>_1``.

    Empty records go first.  Of records with equal keys the one with the smallest id is
    kept, and its id is returned.
    """
    def once(df, suffix):
        best = df.dropna(how="all", subset=list(variables)).groupBy(*keys).agg(
            F.min_by(F.struct(order_by, *variables), order_by).alias("_r"))
        return best.select(*keys, F.col(f"_r.{order_by}").alias(f"_id{suffix}"),
                           *[F.col(f"_r.{v}").alias(v + suffix) for v in variables])
    return once(first, "_0").join(once(second, "_1"), list(keys)).withColumnRenamed("_id_0", order_by).drop("_id_1")


def run_difference(aligned: DataFrame, variables) -> DataFrame:
    return aligned.withColumns({f"{v}_change": F.col(v + "_0") - F.col(v + "_1") for v in variables})


def with_bias_angle(aligned: DataFrame, variable: str) -> DataFrame:
    return aligned.withColumn("angle", bias_angle(F.abs(F.col(variable + "_0")), F.abs(F.col(variable + "_1"))))


def histogram(df: DataFrame, value: str, keys, low=-HALF_PI, high=HALF_PI, n: int = 100) -> DataFrame:
    """Counts in ``n`` equal bins, the last one closed; empty bins count 0.

    Groups without any value in the range are reported too, as all zeros.
    """
    keys = list(keys)
    counted = df.withColumn("bin", histogram_bin(value, low, high, n)).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("_c"))
    entry = F.when(F.col("bin").isNotNull(), F.struct("bin", "_c"))
    packed = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_counts"))  # at most ``n`` entries
    return packed.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        *keys, "bin", bin_centre("bin", low, high, n).alias("centre"),
        F.coalesce(F.try_element_at("_counts", F.col("bin")), F.lit(0)).cast("long").alias("frequency"))


def all_bins(df: DataFrame, keys, n: int) -> DataFrame:
    return df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def histogram_2d(df: DataFrame, first: str, second: str, keys, high: float = 5.0, n: int = 100) -> DataFrame:
    """Counts of |first| against |second| on [0, high] squared; occupied bins only."""
    return (
        df.withColumn("bin_0", histogram_bin(F.abs(F.col(first)), 0.0, high, n))
        .withColumn("bin_1", histogram_bin(F.abs(F.col(second)), 0.0, high, n))
        .filter(F.col("bin_0").isNotNull() & F.col("bin_1").isNotNull())
        .groupBy(*keys, "bin_0", "bin_1").agg(F.count(F.lit(1)).alias("frequency"))
    )


# ---- bootstrap of profiles ----------------------------------------------------------------

# Draws come from a mixed 32-bit word of the seed, the profile and the replicate: multiply, shift
# and xor, which columns, arrays and any SQL engine can repeat.  Fixed values: a mixer's multipliers.
MASK, GOLDEN, FIRST, SECOND = 0xFFFFFFFF, 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35


def _named(x: Column, step) -> Column:
    """``step`` of a value that it uses more than once, so that the expression of the value is written once."""
    return F.get(F.transform(F.array(x), step), F.lit(0))


def _times(x: Column, factor: int) -> Column:
    """Product modulo 2**32, in parts that fit a BIGINT."""
    return _named(x, lambda v: (v.bitwiseAND(0xFFFF) * factor + (F.shiftrightunsigned(v, 16) * factor).bitwiseAND(0xFFFF) * 65536).bitwiseAND(MASK))


def _mixed(x: Column) -> Column:
    x = _times(_named(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 16))), FIRST)
    x = _times(_named(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 13))), SECOND)
    return _named(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 16)))


def _mixed_words(x: np.ndarray) -> np.ndarray:
    """As ``_mixed``, on 32-bit words."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(FIRST)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(SECOND)
    return x ^ (x >> np.uint32(16))


def _whole(key: Column, kind: str) -> Column:
    """A key as a whole number: an integer is itself, another one its hash; NULL is 0."""
    return F.coalesce(key.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key), F.lit(0).cast("long"))


def key_words(seed: int, whole: Column) -> tuple[Column, Column]:
    """Two 32-bit words of the seed and a whole number."""
    low, high = whole.bitwiseAND(MASK), F.shiftrightunsigned(whole, 32)
    return _mixed(low.bitwiseXOR(seed & MASK)), _mixed(_times(high.bitwiseXOR((seed >> 32) & MASK), GOLDEN).bitwiseXOR(low))


def uniform(words: tuple[Column, Column], rep: Column | None = None) -> Column:
    """A reproducible number in [0, 1) from the words of a key, and of a replicate."""
    a, b = words
    x = b if rep is None else b.bitwiseXOR(_times(rep.cast("long") + 1, GOLDEN))
    return _mixed(a.bitwiseXOR(_mixed(x))).cast("double") / F.lit(4294967296.0)


def _poisson_steps(terms: int) -> list[float]:
    total, p, steps = 0.0, math.exp(-1.0), []
    for k in range(terms):
        total += p
        steps.append(total)
        p /= k + 1
    return steps


def poisson_weight(u: Column, terms: int = 12) -> Column:
    """Poisson(1) count for a uniform number: how many cumulative probabilities it reaches."""
    steps = _poisson_steps(terms)
    out = F.lit(terms)
    for k in range(terms - 1, -1, -1):
        out = F.when(u < F.lit(steps[k]), F.lit(k)).otherwise(out)
    return out


#: Profiles whose cells meet the weights of all replicates in one matrix product.
UNIT = 2048
#: Profiles of a unit where a group has many: its products are added up before they leave the task.
LARGE_UNIT = 65536
#: Units of a group up to which they stay small, so that there is work for many tasks.
SMALL_UNITS = 16
#: Cells added up at a time.
COLUMNS = 4096


def _drawn_words(words: np.ndarray, n_boot: int) -> np.ndarray:
    reps = (np.arange(1, n_boot + 1, dtype=np.uint32) * np.uint32(GOLDEN))[None, :]
    a, b = (words[:, k].astype(np.uint32)[:, None] for k in (0, 1))
    return _mixed_words(a ^ _mixed_words(b ^ reps))


def _uniform_numbers(words: np.ndarray, n_boot: int) -> np.ndarray:
    """As ``uniform``: a row for each pair of words, a column for each replicate."""
    return _drawn_words(words, n_boot) / 4294967296.0


def poisson_weights(words: np.ndarray, n_boot: int, terms: int = 12) -> np.ndarray:
    """As ``poisson_weight(uniform(...))``: a row for each pair of words, a column for each replicate."""
    drawn = _drawn_words(words, n_boot)
    out = np.zeros(drawn.shape, np.uint8)
    for step in _poisson_steps(terms):
        out += drawn >= np.uint32(min(math.ceil(step * 4294967296.0), MASK))
    return out


def _products(keys: list[str], n_boot: int):
    def multiply(key, cells):
        """Cells of a unit's profiles (profiles by cells) times their weights (replicates by profiles), added up."""
        ids, first, row = np.unique(cells["_id"].to_numpy(), return_index=True, return_inverse=True)
        words = cells[["_a", "_b"]].to_numpy()[first]
        names, column = np.unique(cells["_cell"].to_numpy(), return_inverse=True)
        order = np.lexsort((row, column // COLUMNS))
        row, column, x = row[order], column[order], cells["_x"].to_numpy()[order]
        parts = []
        for left in range(0, len(names), COLUMNS):
            here = slice(*np.searchsorted(column // COLUMNS, [left // COLUMNS, left // COLUMNS + 1]))
            known, own = np.unique(row[here], return_inverse=True)
            at, value = column[here] - left, x[here]
            sums = np.zeros((n_boot, min(COLUMNS, len(names) - left)))
            for start in range(0, len(known), UNIT):
                part = slice(*np.searchsorted(own, [start, start + UNIT]))
                held, place = np.unique(at[part], return_inverse=True)
                drawn = known[start:start + UNIT]
                matrix = np.zeros((len(drawn), len(held)))
                np.add.at(matrix, (own[part] - start, place), value[part])
                sums[:, held] += poisson_weights(words[drawn], n_boot).T.astype(np.float64) @ matrix
            rep, at = np.nonzero(sums)
            parts.append(pd.DataFrame({"rep": rep.astype(np.int32), "_cell": names[left + at], "_w": sums[rep, at]}))
        out = pd.concat(parts, ignore_index=True)
        return pd.concat([pd.DataFrame({k: [v] * len(out) for k, v in zip(keys, key)}, index=out.index), out], axis=1)
    return multiply


class PoissonDraws:
    """How often a profile is drawn in a replicate: Poisson(1), from its id alone.

    The weight is a function of (seed, profile, replicate), so it is computed where the
    profile is, and nothing is joined.
    """

    def __init__(self, n_boot: int, seed: int, key: str = "profile_id"):
        self.n_boot, self.seed, self.key = n_boot, seed, key

    def weigh(self, df: DataFrame) -> DataFrame:
        """Rows holding ``rep`` with their ``weight``; rows not drawn go."""
        words = key_words(self.seed, _whole(F.col(self.key), df.schema[self.key].dataType.simpleString()))
        return df.withColumn("_u", uniform(words, F.col("rep"))).withColumn(
            "weight", poisson_weight(F.col("_u"))).drop("_u").filter("weight > 0")

    def spread(self, df: DataFrame) -> DataFrame:
        """One row per replicate a row is drawn in."""
        return self.weigh(df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(self.n_boot - 1)))))

    def add_up(self, cells: DataFrame, keys, unit: int = UNIT, large: int = LARGE_UNIT) -> DataFrame:
        """(keys, rep, _cell, _w): ``_x`` of each profile's cells times its weight, summed; zeros are left out.

        Profiles of a group are dealt to units, and a unit is a sum of products of two matrices.  So a
        profile is never repeated per replicate, and a unit gives a row per replicate and cell.  Up to
        ``SMALL_UNITS`` a unit has about ``unit`` profiles; larger groups get units of up to about ``large``.
        """
        keys = list(keys)
        types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
        whole = _whole(F.col(self.key), types[self.key])
        about = F.approx_count_distinct(whole)  # decides the dealing alone
        sizes = cells.groupBy(*keys).agg(F.greatest(F.lit(1), F.least(F.ceil(about / unit), F.greatest(
            F.lit(SMALL_UNITS), F.ceil(about / large)))).cast("long").alias("_units"))
        sizes = sizes.select("_units", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        a, b = key_words(self.seed, whole)
        dealt = cells.join(sizes, same).select(
            *keys, F.pmod(F.xxhash64(self.key), "_units").alias("_unit"), whole.alias("_id"), a.alias("_a"), b.alias("_b"),
            F.col("_cell").cast("int").alias("_cell"), F.col("_x").cast("double").alias("_x"))
        schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", rep int, _cell int, _w double"
        # Few bytes, much arithmetic: a fixed number of tasks, which are not merged by size.
        tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return dealt.repartition(tasks, *keys, "_unit").groupBy(*keys, "_unit").applyInPandas(_products(keys, self.n_boot), schema).groupBy(
            *keys, "rep", "_cell").agg(F.sum("_w").alias("_w"))


#: Profiles numbered one after another whose draws, or whose weights, are made in one task.
BLOCK = 131072
#: Replicates drawn in one task.
CHUNK = 125
#: Profiles of a group up to which a task holds them all, 20 bytes each, so that no draw leaves it.
WHOLE = 1 << 23
#: Profiles in one row of such a group.
PIECE = 65536


def _gaps(numbers: np.ndarray) -> np.ndarray:
    """Sorted whole numbers as gaps of one byte; 255 adds to the gap after it."""
    steps = np.diff(numbers, prepend=0)
    over = steps // 255
    out = np.full(len(steps) + int(over.sum()), 255, np.uint8)
    out[np.cumsum(over + 1) - 1] = steps % 255
    return out


def _from_gaps(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255]


def _numbers_drawn(keys: list[str], n_boot: int):
    """Numbers that a block's profiles draw in a chunk of replicates, by the block of the profile drawn."""
    def draw(key, rows):
        *group, _, chunk = key
        words, n = rows[["_a", "_b"]].to_numpy(), int(rows["_n"].iloc[0])
        edges = np.arange(0, n + BLOCK, BLOCK)
        sizes, drawn = [[] for _ in edges[1:]], [[] for _ in edges[1:]]
        for rep in range(chunk * CHUNK, min(n_boot, (chunk + 1) * CHUNK)):
            numbers = np.sort(np.floor(_numbers_of(words, rep) * n).astype(np.int64))
            cuts = np.searchsorted(numbers, edges)
            for k in range(len(edges) - 1):
                gaps = _gaps(numbers[cuts[k]:cuts[k + 1]] - edges[k])
                sizes[k].append(len(gaps))
                drawn[k].append(gaps.tobytes())
        out = pd.DataFrame({"_block": np.arange(len(sizes), dtype=np.int32), "_chunk": chunk,
                            "_sizes": [np.array(s, np.uint32).tobytes() for s in sizes], "_drawn": [b"".join(d) for d in drawn]})
        return pd.concat([pd.DataFrame({k: [v] * len(out) for k, v in zip(keys, group)}, index=out.index), out], axis=1)
    return draw


def _numbers_of(words: np.ndarray, rep: int) -> np.ndarray:
    turn = np.uint32((rep + 1) * GOLDEN & MASK)
    a, b = words[:, 0].astype(np.uint32), words[:, 1].astype(np.uint32)
    return _mixed_words(a ^ _mixed_words(b ^ turn)) / 4294967296.0


def _weights_drawn(n_boot: int, drawn: pd.DataFrame, chunk: int):
    """(rep, weights) of a block: how often each of its numbers was drawn."""
    tables = [np.frombuffer(s, np.uint32).astype(np.int64) for s in drawn["_sizes"]]
    ends = [np.r_[0, np.cumsum(t)] for t in tables]
    gaps = [np.frombuffer(d, np.uint8) for d in drawn["_drawn"]]
    for k, rep in enumerate(range(chunk * CHUNK, min(n_boot, (chunk + 1) * CHUNK))):
        weights = np.zeros(BLOCK, np.int64)
        for e, g in zip(ends, gaps):
            weights += np.bincount(_from_gaps(g[e[k]:e[k + 1]]), minlength=BLOCK)
        yield rep, weights


_PIECE = {"_numbers": np.uint32, "_a": np.uint32, "_b": np.uint32, "_x": np.int64, "_known": np.bool_}


def _pieces(keys: list[str], schema: pa.Schema):
    """Rows with a number, two words and a value, packed as bytes by group."""
    def packed(group, n, rows):
        return [*group, n, *[np.concatenate([r[k] for r in rows]).tobytes() for k in range(len(_PIECE))]]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def pack(batches):
        held = {}
        for batch in batches:
            groups = batch.select([*keys, "_n"]).to_pandas()
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in zip(("_number", "_a", "_b", "_x", "_known"), _PIECE.values())]
            for group, at in groups.groupby([*keys, "_n"], dropna=False).indices.items():
                *group, n = group
                rows = held.setdefault((tuple(group), int(n)), [])
                rows.append([c[at] for c in columns])
                if sum(len(r[0]) for r in rows) >= PIECE:
                    yield table([packed(group, int(n), held.pop((tuple(group), int(n))))])
        if held:
            yield table([packed(group, n, rows) for (group, n), rows in held.items()])
    return pack


def _totals_of_whole(keys: list[str], n_boot: int, schema: pa.Schema):
    """Totals of a chunk of replicates over a group's profiles, all of which are here."""
    def total(group, pieces):
        chunk, n = group[-1].as_py(), pieces.column("_n")[0].as_py()
        numbers, a, b, x, known = ([np.frombuffer(v.as_buffer(), t) for v in pieces.column(c)] for c, t in _PIECE.items())
        value, told = np.zeros(n, np.int64), np.zeros(n, bool)
        for at, v, k in zip(numbers, x, known):
            value[at], told[at] = v, k
        words = [np.stack([p, q], axis=1) for p, q in zip(a, b)]
        all_told, rows = bool(told.all()), []
        for rep in range(chunk * CHUNK, min(n_boot, (chunk + 1) * CHUNK)):
            drawn, sum_ = np.zeros(n, bool), np.int64(0)
            for part in words:
                at = np.floor(_numbers_of(part, rep) * n).astype(np.int64)
                sum_ += value[at].sum()
                drawn[at] = True
            some = all_told or bool((drawn & told).any())
            rows.append((*[g.as_py() for g in group[:-1]], rep, n, int(np.count_nonzero(drawn)), int(sum_) if some else None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    return total


class MultinomialDraws:
    """As ``PoissonDraws``, but exactly as many draws per replicate as there are profiles.

    Profiles are numbered by slot (a hash) and then inside it, so the numbering of a large
    group is spread over many tasks; each profile then makes one draw per replicate.  Totals are found
    where all profiles of a group are, packed, once for each chunk of replicates; draws then go nowhere.  In groups of
    more than ``WHOLE`` profiles, and for ``table``, draws go
    from blocks of drawing profiles to blocks of drawn ones as sorted numbers, about a byte a draw.
    """

    def __init__(self, profiles: DataFrame, n_boot: int, seed: int, keys, key: str = "profile_id", slots: int = 256):
        self.n_boot, self.keys, self.key, self._table = n_boot, list(keys), key, None
        keys = self.keys
        words = key_words(seed, _whole(F.col(key), profiles.schema[key].dataType.simpleString()))
        rows = profiles.select(*keys, key).distinct().withColumn("_slot", F.floor(uniform(words) * slots).cast("int"))
        w = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sizes = rows.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_c"))
        starts = sizes.select(*keys, "_slot", (F.sum("_c").over(w) - F.col("_c")).alias("_start"),
                              F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"))
        inside = Window.partitionBy(*keys, "_slot").orderBy(key)
        self.numbered = cut_lineage(
            rows.withColumn("_at", F.row_number().over(inside) - 1).join(starts, [*keys, "_slot"])
            .select(*keys, key, (F.col("_start") + F.col("_at")).alias("_number"), "_n", words[0].alias("_a"), words[1].alias("_b")))

    def _by_chunk(self, df: DataFrame) -> DataFrame:
        """Rows with ``_number``, dealt by block, once for each chunk of replicates."""
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.withColumns({"_block": F.expr(f"cast(_number div {BLOCK} as int)"), "_at": F.expr(f"cast(_number % {BLOCK} as int)"),
                               "_chunk": F.explode(F.sequence(F.lit(0), F.lit((self.n_boot - 1) // CHUNK)))}).drop("_number").repartition(
            tasks, *self.keys, "_block", "_chunk")

    def _of_blocks(self, rows: DataFrame, found, schema: str, numbered: DataFrame | None = None) -> DataFrame:
        """``found(rep, weights, rows)`` for each replicate and block of ``rows`` (with ``_number``; ``_at`` is the place in its block)."""
        keys, n_boot, by = self.keys, self.n_boot, [*self.keys, "_block", "_chunk"]
        types = {f.name: f.dataType.simpleString() for f in self.numbered.schema.fields}
        head = ", ".join(f"`{k}` {types[k]}" for k in keys)
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        drawn = self._by_chunk((self.numbered if numbered is None else numbered).select(*keys, "_number", "_n", "_a", "_b")).groupBy(*by).applyInPandas(
            _numbers_drawn(keys, n_boot), f"{head}, _block int, _chunk int, _sizes binary, _drawn binary").repartition(tasks, *by)

        def meet(key, drawn, rows):
            parts = [found(rep, weights, rows) for rep, weights in _weights_drawn(n_boot, drawn, key[-1])] if len(rows) else []
            out = pd.concat(parts, ignore_index=True) if parts else found(0, np.zeros(BLOCK, np.int64), rows).iloc[:0]
            return pd.concat([pd.DataFrame({k: [v] * len(out) for k, v in zip(keys, key)}, index=out.index), out], axis=1)

        return drawn.groupBy(*by).cogroup(self._by_chunk(rows).groupBy(*by)).applyInPandas(meet, f"{head}, {schema}")

    @property
    def table(self) -> DataFrame:
        """(keys, key, rep, weight), one row per profile and replicate it is drawn in; written when first asked for."""
        if self._table is None:
            key = self.key

            def found(rep, weights, rows):
                times = weights[rows["_at"].to_numpy(np.int64)]
                return pd.DataFrame({key: rows[key][times > 0], "rep": np.int32(rep), "weight": times[times > 0].astype(np.int32)})

            kind = self.numbered.schema[key].dataType.simpleString()
            self._table = cut_lineage(self._of_blocks(
                self.numbered.select(*self.keys, key, "_number"), found, f"`{key}` {kind}, rep int, weight int"))
        return self._table

    def totals(self, value: str) -> DataFrame:
        """(keys, rep, draws, profiles, total): draws, profiles drawn, and the sum of a whole-number column of theirs by draws."""
        def found(rep, weights, rows):
            times, x = weights[rows["_at"].to_numpy(np.int64)], rows["_x"].to_numpy(np.int64)
            known = rows["_known"].to_numpy(bool) & (times > 0)
            return pd.DataFrame({"rep": [np.int32(rep)], "draws": [int(times.sum())], "profiles": [int((times > 0).sum())],
                                 "total": [int((times * x)[known].sum()) if known.any() else None]}).astype({"total": "Int64"})

        rows = self.numbered.withColumn("_x", F.coalesce(F.col(value).cast("long"), F.lit(0).cast("long"))).withColumn("_known", F.col(value).isNotNull())
        out = self._of_whole(rows.filter(F.col("_n") <= WHOLE))
        large = self.numbered.filter(F.col("_n") > WHOLE)
        if not large.isEmpty():
            there = self._of_blocks(rows.filter(F.col("_n") > WHOLE).select(*self.keys, "_number", "_x", "_known"), found,
                                    "rep int, draws long, profiles long, total long", large)
            out = out.unionByName(there.groupBy(*self.keys, "rep").agg(*[F.sum(c).alias(c) for c in ("draws", "profiles", "total")]))
        return out.filter("profiles > 0")

    def _of_whole(self, rows: DataFrame) -> DataFrame:
        """Totals of groups that a task can hold: their profiles go to one task for each chunk of replicates."""
        keys, n_boot, by = self.keys, self.n_boot, [*self.keys, "_chunk"]
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        head = rows.select(*keys).schema
        pieces = T.StructType([*head.fields, T.StructField("_n", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in _PIECE]])
        totals = T.StructType([*head.fields, T.StructField("rep", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("draws", "profiles", "total")]])
        packed = rows.select(*keys, "_n", "_number", "_a", "_b", "_x", "_known").mapInArrow(_pieces(keys, to_arrow_schema(pieces)), pieces)
        dealt = packed.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // CHUNK)))).repartition(tasks, *by)
        return dealt.groupBy(*by).applyInArrow(_totals_of_whole(keys, n_boot, to_arrow_schema(totals)), totals)

    def weigh(self, df: DataFrame) -> DataFrame:
        return df.join(self.table, [*self.keys, self.key, "rep"])

    def spread(self, df: DataFrame) -> DataFrame:
        return df.join(self.table, [*self.keys, self.key])

    def add_up(self, cells: DataFrame, keys) -> DataFrame:
        """As for ``PoissonDraws``; the written draws are joined, one row per profile and replicate."""
        packed = cells.groupBy(*keys, self.key).agg(F.collect_list(F.struct("_cell", "_x")).alias("_cells"))
        return self.spread(packed).select(*keys, "rep", "weight", F.inline("_cells")).groupBy(*keys, "rep", "_cell").agg(
            F.sum(F.col("_x").cast("double") * F.col("weight")).alias("_w"))


def bootstrap_histogram(df: DataFrame, value: str, draws, keys=("region", "season"),
                        low=-HALF_PI, high=HALF_PI, n: int = 100, key="profile_id") -> DataFrame:
    """(keys, rep, bin, frequency), occupied bins only.

    A profile's levels become its bin counts (at most ``n``), which ``draws`` adds up.
    """
    keys = list(keys)
    binned = df.withColumn("_cell", histogram_bin(value, low, high, n)).filter(F.col("_cell").isNotNull()).groupBy(
        *keys, key, "_cell").agg(F.count(F.lit(1)).alias("_x"))
    return draws.add_up(cut_lineage(binned), keys).select(
        *keys, "rep", F.col("_cell").alias("bin"), F.col("_w").cast("long").alias("frequency"))


def bootstrap_mean(df: DataFrame, value: str, draws, keys=("region", "season"), key="profile_id") -> DataFrame:
    keys = list(keys)
    parts = df.groupBy(*keys, key).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    # Cells: the sum, the number of values, the profile itself (so that a replicate without values is seen).
    cells = parts.select(*keys, key, F.posexplode(F.array(
        F.coalesce(F.col("_s").cast("double"), F.lit(0.0)), F.col("_c").cast("double"), F.lit(1.0))).alias("_cell", "_x"))
    of = lambda cell: F.coalesce(F.sum(F.when(F.col("_cell") == cell, F.col("_w"))), F.lit(0.0))
    return draws.add_up(cut_lineage(cells), keys).groupBy(*keys, "rep").agg(ratio(of(0), of(1)).alias("mean"))


def bootstrap_median(df: DataFrame, value: str, draws, keys=("region", "season"), key="profile_id",
                     bins: int = BINS) -> DataFrame:
    """(keys, rep, median), exact.

    All replicates share one set of bins, counted per profile first.  The medians of the
    replicates fall into a few of them, which are cut into bins again, shared again; only the
    values in the few small bins hit then are repeated per replicate and ranked.
    """
    keys = list(keys)
    by = [*keys, "rep"]
    rows = df.filter(F.col(value).isNotNull()).select(*keys, key, F.col(value).alias("_v"))

    def weights(placed):
        """Draws of each bin (``_part``, counted within keys) in each replicate."""
        counts = placed.groupBy(*keys, key, F.col("_part").alias("_cell")).agg(F.count(F.lit(1)).alias("_x"))
        return cut_lineage(draws.add_up(cut_lineage(counts), keys).select(*by, F.col("_cell").alias("_part"), F.col("_w").cast("long").alias("_w")))

    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    placed = rows.join(ends, keys).withColumn("_part", _bin(F.col("_v"), F.col("_lo"), F.col("_hi"), bins)).drop("_lo", "_hi")
    per_rep = weights(placed)
    ranks = per_rep.groupBy(*by).agg(F.sum("_w").alias("_n")).select(
        *by, F.explode(F.array_distinct(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2")))).alias("rank")).withColumn("_rest", F.col("rank"))
    hits = cut_lineage(_locate(per_rep, by, ranks, by, "_part").select(*by, F.col("_part").alias("_wide"), "rank", "_rest"))

    # Bins hit, and their own ranges; at most two per replicate.
    inside = cut_lineage(placed.withColumnRenamed("_part", "_wide").join(hits.select(*keys, "_wide").distinct(), [*keys, "_wide"]))
    ends = inside.groupBy(*keys, "_wide").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    inside = inside.join(ends, [*keys, "_wide"]).withColumn(
        "_part", F.col("_wide") * bins + _bin(F.col("_v"), F.col("_lo"), F.col("_hi"), bins)).drop("_lo", "_hi", "_wide")
    per_rep = weights(inside).withColumn("_wide", F.expr(f"_part div {int(bins)}").cast("int"))
    hits = cut_lineage(_locate(per_rep, [*by, "_wide"], hits, [*by, "_wide"], "_part").select(*by, "_part", F.col("_rest").alias("rank")))

    # Which replicates look into a shared bin: at most ``n_boot`` per bin.
    asked = hits.groupBy(*keys, "_part").agg(F.collect_set("rep").alias("_reps"))
    # Equal values of a profile go together, so that a common value is repeated per profile only.
    near = inside.groupBy(*keys, key, "_part", "_v").agg(F.count(F.lit(1)).alias("_times")).join(asked, [*keys, "_part"]).withColumn(
        "rep", F.explode("_reps")).drop("_reps")
    repeated = cut_lineage(draws.weigh(near).groupBy(*by, "_part", "_v").agg(F.sum(F.col("_times") * F.col("weight")).alias("weight")))
    found = select_ranks(repeated, [*by, "_part"], "_v", hits, "weight")
    # One rank where the number of draws is odd, else two.
    return found.groupBy(*by).agg(F.avg("_v").alias("median"))


def summarise_replicates(df: DataFrame, value: str, keys, n_boot: int, zero_fill: DataFrame | None = None,
                         probabilities=QUANTILES) -> DataFrame:
    """(keys, mean, q) over replicates; ``q`` is an array in the order of ``probabilities``.

    With ``zero_fill`` (all keys to report) an absent replicate counts as 0.  A group holds
    at most ``n_boot`` values.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_x"), F.lit(1).cast("long").alias("_f"))
    if zero_fill is not None:
        seen = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
        missing = zero_fill.select(*keys).join(seen, keys, "left").select(
            *keys, F.lit(0.0).alias("_x"), (F.lit(n_boot) - F.coalesce("_c", F.lit(0))).cast("long").alias("_f"))
        rows = rows.unionByName(missing.filter("_f > 0"))
    probs = F.array(*[F.lit(float(p)) for p in probabilities])
    return rows.groupBy(*keys).agg(
        ratio(F.sum(F.col("_x") * F.col("_f")), F.sum("_f")).alias("mean"), F.percentile("_x", probs, F.col("_f")).alias("q"))


def box_summary(summary: DataFrame, keys) -> DataFrame:
    """Whiskers, quartiles and median from a summary over ``QUANTILES``."""
    at = {p: F.element_at("q", i + 1) for i, p in enumerate(QUANTILES)}
    return summary.select(*keys, at[0.02].alias("whisker_low"), at[0.25].alias("q1"), at[0.5].alias("median"),
                          at[0.75].alias("q3"), at[0.98].alias("whisker_high"))
