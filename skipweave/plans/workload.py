"""Query workloads, the comparison of access paths, and the experiment matrix."""

from __future__ import annotations

import random
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..column import Column
from ..functions.binning import Bins, bins_of
from ..operators import bitmap, runs, scan, signature, zonemap
from ..operators.scan import Range

QUERIES = 10
#: Block sizes and bins of the matrix; fixed values of the experiments.
BLOCK_BYTES = (64, 128, 256)
MOST_BINS = (64, 128, 256)

METRICS = "query int, method string, low double, high double, n bigint, selectivity double, usec bigint"
BUILT = "column string, block_bytes int, most_bins int, bins int, n_blocks bigint, n_vectors bigint, n_entries bigint, index_bytes bigint, percent bigint, usec bigint, usec_per_1000 double"


def growing_ranges(bins: Bins, largest, queries: int = QUERIES) -> list[Range]:
    """Ranges from the second bound on, each a tenth of the largest value longer; the first is empty. Ends are computed
    in double, cut to the column's type and clipped to the largest value."""
    low = bins.bounds[1]
    out = []
    for i in range(queries):
        high = low + i * largest / 10.0
        high = min(high if bins.type.floating else int(high), largest)
        out.append(Range(min(low, high), high))
    return out


def ranges_by_bin(bins: Bins, filled: list[int], queries: int = QUERIES, seed: int = 0) -> list[Range]:
    """Ranges that begin and end at bounds: a random bin, then i tenths of the bins further, cut to bins that hold values
    (filled, in order). Ends are open at the sides of the first and last bin."""
    pick, out = random.Random(seed), []
    least, most = bins.type.least, bins.type.most
    for i in range(queries):
        first = pick.randrange(len(filled))
        last = min(len(filled) - 1, first + i * len(filled) // 10)
        a, b = filled[first], filled[last]
        out.append(Range(bins.bounds[a - 1] if a else least, bins.bounds[b] if b < len(bins) - 1 else most))
    return out


def ranges_by_data(column: Column, queries: int = QUERIES, seed: int = 0) -> list[Range]:
    """Ranges between two sampled values each."""
    values = [r.v for r in column.rows.where("v is not null").orderBy(F.xxhash64("pos", F.lit(seed)), "pos").limit(2 * queries).collect()]
    return [Range(min(a, b), max(a, b)) for a, b in zip(values[::2], values[1::2])]


def timed(df: DataFrame) -> tuple[int, int]:
    """The first row's first value and the microseconds it took."""
    began = time.perf_counter_ns()
    value = df.first()[0]
    return value, (time.perf_counter_ns() - began) // 1000


def run_workload(column: Column, wanted: list[Range], block_bytes: int = 64, most_bins: int = 64, check: bool = True, others: Iterable[tuple[int, int]] = ()) -> DataFrame:
    """A row for each query and access path: the plain scan, the zonemap, one signature index, the bitmaps, and with
    `others` the signatures of each of those (block bytes, bins), named by them. Indexes are built once and kept for all
    queries; those of the others are counted together, and each is given its share of the time. Raises ValueError where a path's count differs from the scan's."""
    zones = zonemap.build_zonemap(column, block_bytes)
    index = signature.build_signatures(column, block_bytes, most_bins)
    more = {f"signature {b}x{m}": signature.build_signatures(column, b, m) for b, m in others}
    zones.zones = zones.zones.cache()
    for one in (index, *more.values()):
        one.blocks = one.blocks.cache()
    words = bitmap.wah_encode(column, index.bins).cache()
    rows = []
    together: dict[str, tuple] = {}
    for name, one in more.items():
        began = time.perf_counter_ns()
        found = one.counts(wanted).first()
        together[name] = found, (time.perf_counter_ns() - began) // 1000 // max(1, len(wanted))
    for q, r in enumerate(wanted):
        plans = {"scan": scan.scan_count(column, r), "zonemap": zones.count(r), "signature": index.count(r), "bitmap": bitmap.bitmap_count(column, index.bins, words, r)}
        counts = {}
        for method, plan in plans.items():
            counts[method], usec = timed(plan)
            rows.append((q, method, float(r.low), float(r.high), counts[method], counts[method] * 100.0 / max(1, column.n), usec))
        for name, (found, usec) in together.items():
            counts[name] = found[q]
            rows.append((q, name, float(r.low), float(r.high), found[q], found[q] * 100.0 / max(1, column.n), usec))
        if check and len(set(counts.values())) > 1:
            raise ValueError(f"query {q}: counts differ: {counts}")
    for df in (zones.zones, words, *(one.blocks for one in (index, *more.values()))):
        df.unpersist()
    return column.rows.sparkSession.createDataFrame(rows, METRICS)


def variants() -> Iterator[tuple[int, int]]:
    return ((b, m) for b in BLOCK_BYTES for m in MOST_BINS)


def experiment_matrix(column: Column) -> DataFrame:
    """A row for each block size and number of bins: the index's size and the time to build it."""
    rows = []
    for block_bytes, most in variants():
        began = time.perf_counter_ns()
        index = signature.build_signatures(column, block_bytes, most, bins_of(column, most))
        index.blocks = index.blocks.cache()
        n_blocks = index.blocks.count()
        usec = (time.perf_counter_ns() - began) // 1000
        size = runs.size_of(index, runs.run_lengths(index)).first()
        rows.append((column.name, block_bytes, most, len(index.bins), n_blocks, size["n_vectors"], size["n_entries"], size["index_bytes"], size["percent"], usec, usec * 1000.0 / max(1, column.n)))
        index.blocks.unpersist()
    return column.rows.sparkSession.createDataFrame(rows, BUILT)
