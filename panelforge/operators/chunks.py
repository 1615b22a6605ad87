"""Chunks of variants per chromosome for work that is done piece by piece.

Cuts depend on earlier cuts, so the places of a chromosome are walked in order.  They are first reduced to distinct places
with counts - no more than a chromosome has bases - and streamed, never held: a task keeps a few numbers and finds each cut by
search within an Arrow batch, so that the work per place is that of handing it over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "chromosome string, first long, last long, n_variants long"


def chunk_places(places: DataFrame, size: int, at_least: int = 200, centromeres: dict[str, int] | None = None) -> DataFrame:
    """(chromosome, chunk, first, last, n_variants).

    A chunk ends before the centromere, and where it spans ``size`` bases and holds ``at_least`` variants; a chunk with
    fewer is joined to the one before.
    """
    ends = centromeres or {}
    counted = places.where("chromosome is not null and position is not null").groupBy("chromosome", "position").agg(F.count("*").alias("n"))
    ordered = counted.repartition("chromosome").sortWithinPartitions("chromosome", "position")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chrom, out = None, []
        first = last = n = 0
        past = True

        def close() -> None:
            if n:
                if out and out[-1][0] == chrom and n < at_least:
                    out[-1][2], out[-1][3] = last, out[-1][3] + n
                else:
                    out.append([chrom, first, last, n])

        for pdf in batches:
            for c, part in pdf.groupby("chromosome", sort=False):
                pos, total = part["position"].to_numpy(np.int64), np.cumsum(part["n"].to_numpy(np.int64))
                i = 0
                if c != chrom:
                    close()
                    chrom, first, n, past = c, int(pos[0]), 0, c not in ends
                while i < len(pos):
                    done = int(total[i - 1]) if i else 0
                    if not past and pos[i] >= ends[c]:
                        close()
                        first, n, past = int(pos[i]), 0, True
                    # the first place at which the chunk is long and full enough, or the centromere before it
                    at = max(int(np.searchsorted(pos, first + size)), int(np.searchsorted(total, done + at_least - n)), i)
                    stop = min(at + 1, len(pos), int(np.searchsorted(pos, ends[c])) if not past else len(pos))
                    n, last = n + int(total[stop - 1]) - done, int(pos[stop - 1])
                    if stop == at + 1:
                        close()
                        first, n = last + 1, 0
                    i = stop
            # all but the newest chunk are final
            if len(out) > 1:
                yield pd.DataFrame(out[:-1], columns=["chromosome", "first", "last", "n_variants"])
                out = out[-1:]
        close()
        if out:
            yield pd.DataFrame(out, columns=["chromosome", "first", "last", "n_variants"])

    return ordered.mapInPandas(walk, SCHEMA)
