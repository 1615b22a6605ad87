"""The best representative of each group of catalogue entries that describe one variant on one panel.

Grouping: complete rows group by panel, chromosome, place and alleles on either strand; rows one base off and incomplete
rows join the variant their id names on the panel.

Surviving values, method: token-level consensus.  The distinct values of a field in a group are aligned progressively, the
heaviest first, their weighted tokens are voted on per column, and the existing value closest to the consensus survives.
Alignment follows the ranks of the values by weight: each run of ``BUNDLE`` ranks is aligned in turn, then the profiles of the
runs in the order of their ranks, and so on, so that the rule is one at every size and no task holds more than a profile.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.text import chromosome, id_tokens, panel, strip
from panelforge.operators.ordered import ranked
from panelforge.operators.skew import salted_join
from panelforge.session import cut, shuffle_width

#: Values or profiles that are aligned one after the other; the fan-in of the tree of alignments.
BUNDLE = 256
#: Cells of an alignment table that are kept for the way back; larger tables are halved (memory bound; never changes a score).
TABLE_CELLS = 16_000_000
#: Rows that may be broadcast.
FEW = 100_000
TEXT_FIELDS = ("assaytype", "rsid", "chromosome", "allelea", "alleleb")
INT_FIELDS = ("startposition", "endposition", "imputed", "missing", "numsamples")
#: Number fields and the range in which a value can be true.
NUMBER_FIELDS = {"ref_maf": (0.0, 1.0), "infoscore": (0.0, 1.0), "cr": (0.0, 1.0), "maf": (0.0, 0.5), "hwep": (0.0, 1.0), "errpct": (0.0, 100.0)}
FIELDS = (*TEXT_FIELDS, *INT_FIELDS, *NUMBER_FIELDS)


def _complement(c: Column) -> Column:
    return F.translate(c, "ACGT", "TGCA")


def _alleles(a: Column, b: Column) -> Column:
    """The pair of alleles in either order and on either strand."""
    pair = lambda x, y: F.concat_ws("/", F.least(x, y), F.greatest(x, y))
    return F.least(pair(a, b), pair(_complement(a), _complement(b)))


def described(variants: DataFrame) -> DataFrame:
    """(vid, panel, chrom, pos, a, b, alleles, names, profile) of every row with a vid and a panel."""
    filled = lambda c: F.nullif(F.nullif(F.upper(strip(F.col(c))), F.lit("")), F.lit("."))
    pos = F.col("startposition").cast("long")
    rows = variants.where("vid is not null").select(
        "vid", panel(F.col("assaytype")).alias("panel"), chromosome(F.col("chromosome")).alias("chrom"), F.when(pos > 0, pos).alias("pos"), filled("allelea").alias("a"), filled("alleleb").alias("b"),
        F.filter(F.coalesce(id_tokens(F.col("rsid")), F.array().cast("array<string>")), lambda x: x.rlike("^rs[0-9]+$")).alias("names"),
        F.array(*[F.col(c).cast("double") for c in ("maf", "hwep", "missing", "ref_maf", "infoscore", "cr", "errpct")]).alias("profile"),
    )
    return rows.where("panel is not null").withColumn("alleles", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), _alleles(F.col("a"), F.col("b"))))


VARIANT = ("panel", "chrom", "pos", "alleles")


def _one_off(complete: DataFrame) -> DataFrame:
    """(panel, chrom, alleles, pos, root): the least place of each chain of places one base apart whose entries carry a
    common id.  Only variants in such a chain come out."""
    keyed = complete.select(*VARIANT, F.explode("names").alias("name")).distinct()
    after = keyed.select("panel", "chrom", "alleles", "name", (F.col("pos") + 1).alias("pos"))
    steps = keyed.join(after, ["panel", "chrom", "alleles", "name", "pos"]).select(*VARIANT).distinct().withColumn("root", F.col("pos") - 1)
    links = cut(steps)
    while True:  # pointer doubling: a chain of n places needs log n rounds
        up = links.select("panel", "chrom", "alleles", F.col("pos").alias("root"), F.col("root").alias("_up"))
        moved = links.join(up, ["panel", "chrom", "alleles", "root"], "left").select(*VARIANT, F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved"))
        links = cut(moved)
        if links.where("_moved").limit(1).count() == 0:
            return links.drop("_moved")


def _named(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """(vid, gid) of the rows whose id names a group of ``placed`` on their panel and whose filled alleles agree with it.
    Of several the best is taken: agreement of place and alleles, then of the metrics, then the larger group."""
    groups = _catalogue(placed)
    asked = rows.select("vid", "panel", F.col("chrom").alias("_c"), F.col("pos").alias("_p"), F.coalesce("a", "b").alias("_one"), F.col("alleles").alias("_al"), F.explode("names").alias("name"))
    pairs = salted_join(asked, groups, ["panel", "name"]).drop("name")
    parts = F.split("g_alleles", "/")
    fits_one = F.col("_al").isNotNull() | F.col("_one").isNull() | F.col("g_alleles").isNull() | F.array_contains(parts, F.col("_one")) | F.array_contains(parts, _complement(F.col("_one")))
    fits_alleles = F.col("_al").isNull() | F.col("g_alleles").isNull() | (F.col("_al") == F.col("g_alleles"))
    near = (F.col("_c").isNull() | F.col("g_chrom").isNull() | (F.col("_c") == F.col("g_chrom"))) & (F.col("_p").isNull() | F.col("g_pos").isNull() | (F.abs(F.col("_p") - F.col("g_pos")) <= 1))
    as_int = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    agreement = 4 * as_int(near) + 2 * as_int(F.col("_al") == F.col("g_alleles")) + as_int(F.col("_p") == F.col("g_pos"))
    pairs = cut(pairs.where(fits_alleles & fits_one).groupBy("vid", "gid").agg(F.max(F.struct(agreement.alias("_fit"), "g_size")).alias("_s")).select("vid", "gid", "_s.*"))
    best = cut(pairs.join(pairs.groupBy("vid").agg(F.max("_fit").alias("_fit")), ["vid", "_fit"]))
    tied = cut(best.join(best.groupBy("vid").agg(F.count("*").alias("_n")).where("_n > 1"), "vid", "left_semi").select("vid", "gid"))
    if tied.limit(1).count() == 0:
        return best.select("vid", "gid")
    # where groups are equally good: metrics a row has in common with the rows of each, counted by equi-join so that no group
    # is gathered
    theirs = _kept(placed.select("gid", "vid", "profile"), tied.select("gid").distinct(), ["gid"]).select("gid", F.posexplode("profile").alias("_i", "_x")).where("_x is not null").distinct()
    own = rows.select("vid", F.posexplode("profile").alias("_i", "_x")).where("_x is not null")
    alike = tied.join(own, "vid").join(theirs, ["gid", "_i", "_x"], "left_semi").groupBy("vid", "gid").agg(F.count("*").alias("_alike"))
    return best.join(alike, ["vid", "gid"], "left").groupBy("vid").agg(F.max_by("gid", F.struct(F.coalesce("_alike", F.lit(0)), "g_size", "gid")).alias("gid"))


def _kept(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with the usually few distinct ``keys`` of ``few``: by broadcast where they are seen to be few, otherwise by
    a shuffle that splits hot keys."""
    few = cut(few)
    return rows.join(F.broadcast(few), keys, how) if few.limit(FEW + 1).count() <= FEW else salted_join(rows, few, keys, how)


def group_entries(variants: DataFrame) -> DataFrame:
    """(vid, gid): the group of every row with a vid and a panel; gid is a hash of what the group is known by.

    A row that names no variant and is incomplete is a group of its own.
    """
    rows = cut(described(variants))
    whole = F.col("chrom").isNotNull() & F.col("pos").isNotNull() & F.col("alleles").isNotNull()
    complete = rows.where(whole)
    chains = _one_off(complete)
    placed = _kept(complete, chains, list(VARIANT), "left").withColumn("gid", F.xxhash64("panel", "chrom", F.coalesce("root", "pos"), "alleles"))
    placed = cut(placed.select("vid", *VARIANT, "names", "profile", "gid"))
    found = placed.select("vid", "gid")
    rest = rows.where(~whole)
    # first to complete variants, then to rows that lack the place only, then by the id alone
    rest, found = _attach(rest, found, placed)
    lacking = _by_common_name(rest.where("alleles is not null and size(names) > 0"), ["panel", "alleles"])
    found = found.unionByName(lacking.select("vid", "gid"))
    rest = cut(rest.where("alleles is null or size(names) = 0"))
    rest, found = _attach(rest, found, lacking)
    named = _by_common_name(rest.where("size(names) > 0"), ["panel"])
    return found.unionByName(named.select("vid", "gid")).unionByName(rest.where("size(names) = 0").select("vid", F.xxhash64(F.lit("row"), "vid").alias("gid")))


def _by_common_name(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``gid``: one for all rows of equal ``by`` that hang together by common names.  Only rows with several names link
    names; the least name of each component is found by label propagation over those links."""
    several = rows.where("size(names) > 1").select(*by, F.array_min("names").alias("_a"), F.explode("names").alias("_b")).where("_a <> _b").distinct()
    links = cut(several.unionByName(several.select(*by, F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct())
    first = F.array_min("names")
    if links.limit(1).count() == 0:
        return rows.withColumn("gid", F.xxhash64(F.lit("name"), *by, first))
    label = cut(links.groupBy(*by, "_a").agg(F.least(F.min("_b"), F.col("_a")).alias("_l")))
    while True:  # the least label of a name's neighbours, then that label's own label
        near = links.join(label.withColumnRenamed("_a", "_b"), [*by, "_b"]).groupBy(*by, "_a").agg(F.min("_l").alias("_m"))
        step = label.join(near, [*by, "_a"]).select(*by, "_a", "_l", F.least("_l", "_m").alias("_n"))
        up = step.select(*by, F.col("_a").alias("_n"), F.col("_n").alias("_up"))
        moved = cut(step.join(up, [*by, "_n"], "left").select(*by, "_a", F.least("_n", F.coalesce("_up", "_n")).alias("_l"), (F.least("_n", F.coalesce("_up", "_n")) < F.col("_l")).alias("_moved")))
        label = moved.drop("_moved")
        if moved.where("_moved").limit(1).count() == 0:
            break
    labelled = rows.withColumn("_a", first).join(label, [*by, "_a"], "left")
    return labelled.withColumn("gid", F.xxhash64(F.lit("name"), *by, F.coalesce("_l", "_a"))).drop("_a", "_l")


def _catalogue(placed: DataFrame) -> DataFrame:
    """Groups by the ids that name them on a panel, with their usual place."""
    named = placed.select("panel", "gid", "chrom", "pos", "alleles", F.explode("names").alias("name")).groupBy("panel", "name", "gid", "chrom", "pos", "alleles").agg(F.count("*").alias("_n"))
    return named.groupBy("panel", "name", "gid").agg(F.max("chrom").alias("g_chrom"), F.max_by("pos", F.struct("_n", "pos")).alias("g_pos"), F.max("alleles").alias("g_alleles"), F.sum("_n").alias("g_size"))


def _attach(rest: DataFrame, found: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    got = cut(_named(rest, placed))
    return cut(rest.join(got, "vid", "left_anti")), found.unionByName(got)


def duplicate_pairs(groups: DataFrame) -> DataFrame:
    """(vid_a, vid_b), the smaller first, of all rows of one group; the rows of a large group are spread over tasks."""
    groups = cut(groups)
    a, b = groups.select("gid", F.col("vid").alias("vid_a")), groups.select("gid", F.col("vid").alias("vid_b"))
    return salted_join(a, b, ["gid"], hot_rows=1_000).where("vid_a < vid_b").select("vid_a", "vid_b")


# --- consensus -----------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z]+|\d|[^A-Za-z\d]")
GAP = ""


def tokens_of(value: str) -> list[str]:
    """Words, single digits and single signs."""
    return _TOKEN.findall(value)


#: A column holds the weight of each token voted for it.
Profile = list[dict[str, float]]
#: Scores are whole numbers, so that every way of computing them gives the same alignment.
UNIT, GAP_COST, DOUBT = 1_000_000, 100_000, 50_000


class _Rows:
    """Scores of a column of one profile against all columns of another."""

    def __init__(self, q: Profile, wp: float, wq: float):
        at: dict[str, tuple[list[int], list[float]]] = {}
        for j, col in enumerate(q):
            for t, w in col.items():
                if t != GAP:
                    places = at.setdefault(t, ([], []))
                    places[0].append(j)
                    places[1].append(w / wq)
        self.at = {t: (np.array(j), np.array(w)) for t, (j, w) in at.items()}
        self.m, self.wp = len(q), wp

    def row(self, col: dict[str, float]) -> np.ndarray:
        out = np.full(self.m, -DOUBT, dtype=np.int64)
        for t, w in col.items():
            if t in self.at:
                j, v = self.at[t]
                out[j] += np.rint(np.minimum(w / self.wp, v) * UNIT).astype(np.int64)
        return out


def _last_row(p: Profile, rows: _Rows) -> np.ndarray:
    """Best scores of all of ``p`` against each beginning of the other profile."""
    best, j = -GAP_COST * np.arange(rows.m + 1, dtype=np.int64), GAP_COST * np.arange(rows.m + 1, dtype=np.int64)
    for col in p:
        new = best - GAP_COST
        new[1:] = np.maximum(new[1:], best[:-1] + rows.row(col))
        best = np.maximum.accumulate(new + j) - j
    return best


def _ways(p: Profile, q: Profile, wp: float, wq: float) -> list[tuple[bool, bool]]:
    """Of a best alignment, for each column whether it takes one of ``p`` and one of ``q``.  Tables too large to keep are
    halved at the middle of ``p`` (Hirschberg), which takes memory in proportion to the profiles."""
    n, m = len(p), len(q)
    if not n or not m:
        return [(True, False)] * n + [(False, True)] * m
    if n > 1 and n * m > TABLE_CELLS:
        half = n // 2
        ahead = _last_row(p[:half], _Rows(q, wp, wq))
        back = _last_row(p[half:][::-1], _Rows(q[::-1], wp, wq))[::-1]
        at = int(np.argmax(ahead + back))
        return _ways(p[:half], q[:at], wp, wq) + _ways(p[half:], q[at:], wp, wq)
    rows = _Rows(q, wp, wq)
    best, j = -GAP_COST * np.arange(m + 1, dtype=np.int64), GAP_COST * np.arange(m + 1, dtype=np.int64)
    came = np.zeros((n, m + 1), dtype=np.int8)  # 0 both, 1 only p, 2 only q
    for i, col in enumerate(p):
        down, both = best - GAP_COST, np.empty(m + 1, dtype=np.int64)
        both[0], both[1:] = np.iinfo(np.int64).min // 2, best[:-1] + rows.row(col)
        best = np.maximum.accumulate(np.maximum(down, both) + j) - j
        came[i] = np.where(best == both, 0, np.where(best == down, 1, 2))
    out, i, k = [], n, m
    while i or k:
        way = 2 if not i else 1 if not k else int(came[i - 1, k])
        out.append((way != 2, way != 1))
        i, k = i - (way != 2), k - (way != 1)
    return out[::-1]


def _ways_small(p: Profile, q: Profile, wp: float, wq: float) -> list[tuple[bool, bool]]:
    """The same without arrays, quicker for the few tokens that most values have."""
    n, m = len(p), len(q)
    share = [[sum(int(np.rint(min(w / wp, b[t] / wq) * UNIT)) for t, w in a.items() if t in b and t != GAP) - DOUBT for b in q] for a in p]
    best = [[-GAP_COST * j for j in range(m + 1)]]
    for i in range(n):
        above, row = best[i], [-GAP_COST * (i + 1)]
        for j in range(m):
            row.append(max(above[j] + share[i][j], above[j + 1] - GAP_COST, row[j] - GAP_COST))
        best.append(row)
    out, i, k = [], n, m
    while i or k:
        if i and k and best[i][k] == best[i - 1][k - 1] + share[i - 1][k - 1]:
            way = (True, True)
        elif i and best[i][k] == best[i - 1][k] - GAP_COST:
            way = (True, False)
        else:
            way = (False, True)
        out.append(way)
        i, k = i - way[0], k - way[1]
    return out[::-1]


def align(p: Profile, q: Profile, small: int = 400) -> Profile:
    """Global alignment of two profiles: columns are joined where their votes agree."""
    if not p or not q:
        return p or q
    wp, wq = sum(p[0].values()), sum(q[0].values())
    out: Profile = []
    i = j = 0
    for of_p, of_q in (_ways_small if len(p) * len(q) <= small else _ways)(p, q, wp, wq):
        col = dict(p[i]) if of_p else {GAP: wp}
        for t, w in (q[j] if of_q else {GAP: wq}).items():
            col[t] = col.get(t, 0.0) + w
        i, j = i + of_p, j + of_q
        out.append(col)
    return out


def consensus(p: Profile) -> str:
    """The token with most weight of each column; of equal ones the least."""
    return "".join(min(col, key=lambda t: (-col[t], t)) for col in p)


PROFILE_SCHEMA = "gid long, field string, rank long, value string, profile binary"


def _align_bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by bundle and rank and are aligned as they come; one profile per bundle goes out, with the number of
    the bundle as its rank.  Only the profile of the current bundle is held."""
    key, profile = None, []
    columns = ["gid", "field", "rank", "value", "profile"]
    for pdf in batches:
        out = []
        for gid, field, b, value, w, given in zip(pdf["gid"], pdf["field"], pdf["_b"], pdf["value"], pdf["weight"], pdf["profile"]):
            if (gid, field, b) != key:
                if key is not None:
                    out.append((*key, consensus(profile), pickle.dumps(profile)))
                key, profile = (gid, field, b), []
            profile = align(profile, pickle.loads(given) if given is not None else [{t: float(w)} for t in tokens_of(value)])
        yield pd.DataFrame(out, columns=columns)
    if key is not None:
        yield pd.DataFrame([(*key, consensus(profile), pickle.dumps(profile))], columns=columns)


def _texts(variants: DataFrame) -> DataFrame:
    """(vid, loaded_at, _w, v_<field>, ok_<field>): the filled values of each row as text, with what they are worth: a row
    counts more the more complete it is and if it is not retired; a value outside the range its field can have counts next
    to nothing, so that it survives only where there is no other."""
    blank = lambda c: F.nullif(F.nullif(strip(F.col(c)), F.lit("")), F.lit("."))
    number = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c))
    texts = [blank(c) for c in TEXT_FIELDS]
    ints = [F.when((F.col(c) >= 0) if c not in ("startposition", "endposition") else (F.col(c) > 0), F.col(c)).cast("string") for c in INT_FIELDS]
    doubles = [number(c).cast("string") for c in NUMBER_FIELDS]
    named = variants.where("vid is not null").select("vid", "loaded_at", "retired_at", *[v.alias(f"v_{c}") for c, v in zip(FIELDS, [*texts, *ints, *doubles])])
    filled = sum((F.col(f"v_{c}").isNotNull().cast("int") for c in FIELDS), F.lit(0))
    trust = F.when(F.col("retired_at").isNull(), 1.0).otherwise(0.5)
    return named.select("vid", "loaded_at", (trust * (1.0 + filled / len(FIELDS))).alias("_w"), *[f"v_{c}" for c in FIELDS])


def _possible(field: str, value: Column) -> Column:
    if field not in NUMBER_FIELDS:
        return F.lit(1.0)
    lo, hi = NUMBER_FIELDS[field]
    return F.when(value.cast("double").between(lo, hi), 1.0).otherwise(0.001)


def field_values(rows: DataFrame, fields: Column) -> DataFrame:
    """(gid, field, value, weight, latest): the distinct filled values of the ``fields`` (an array column of names) of each group
    with their weight."""
    entries = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"v_{c}").alias("value"), _possible(c, F.col(f"v_{c}")).alias("ok")) for c in FIELDS])
    wanted = F.filter(entries, lambda e: e["value"].isNotNull() & F.array_contains(fields, e["field"]))
    spread = rows.select("gid", "loaded_at", "_w", F.explode(wanted).alias("e"))
    return spread.groupBy("gid", "e.field", "e.value").agg(F.sum(F.col("_w") * F.col("e.ok")).alias("weight"), F.max("loaded_at").alias("latest"))


def consensus_values(values: DataFrame) -> DataFrame:
    """(gid, field, value) with the consensus of the values of each field of a group."""
    counted = values.groupBy("gid", "field").agg(F.count("*").alias("_n"))
    work = values.join(counted, ["gid", "field"]).withColumn("profile", F.lit(None).cast("binary"))
    few = work.where(F.col("_n") <= BUNDLE).withColumn("_b", F.lit(0).cast("long")).drop("_n")
    done = _aligned(few, [F.desc("weight"), F.col("value")])
    many = cut(work.where(F.col("_n") > BUNDLE).drop("_n", "latest"))
    most = counted.agg(F.max("_n")).first()[0] or 0
    if most <= BUNDLE:
        return done.select("gid", "field", "value")
    many = ranked(many, ["gid", "field"], [F.desc("weight"), F.col("value")])
    while True:
        merged = cut(_aligned(many.withColumn("_b", F.floor(F.col("rank") / BUNDLE)), [F.col("rank")]))
        most = -(-most // BUNDLE)
        if most == 1:
            return done.select("gid", "field", "value").unionByName(merged.select("gid", "field", "value"))
        many = merged.withColumn("weight", F.lit(0.0))


def _aligned(rows: DataFrame, order: list[Column]) -> DataFrame:
    """One profile per (gid, field, bundle).  The width of the shuffle is fixed: the values are few bytes but much work."""
    return rows.repartition(shuffle_width(rows.sparkSession), "gid", "field", "_b").sortWithinPartitions("gid", "field", "_b", *order).select("gid", "field", "_b", "value", "weight", "profile").mapInPandas(_align_bundles, PROFILE_SCHEMA)


def survivors(variants: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per group: ``vid`` (the least of its rows), ``n_entries`` and every field with the existing value closest to
    the consensus (edit distance of the whole texts; of equally close ones the heaviest, then the latest, then the least).

    An entry alone in its group survives as it is.  Of the others most fields have one value in a group; they are settled by
    one combining aggregation.  Only what is left is spread into (group, field, value) rows and aligned.
    """
    groups = cut(groups.select("vid", "gid"))
    several = groups.groupBy("gid").agg(F.count("*").alias("_n")).where("_n > 1")
    rows = cut(_texts(variants).join(_kept(groups, several, ["gid"], "left"), "vid"))
    kind = lambda c: "double" if c in NUMBER_FIELDS else "int" if c in INT_FIELDS else "string"
    lone = rows.where("_n is null").select("vid", F.lit(1).cast("long").alias("n_entries"), *[F.col(f"v_{c}").cast(kind(c)).alias(c) for c in FIELDS])
    rows = rows.where("_n is not null").drop("_n")
    ends = rows.groupBy("gid").agg(F.min("vid").alias("vid"), F.count("*").alias("n_entries"), *[F.min(f"v_{c}").alias(f"lo_{c}") for c in FIELDS], *[F.max(f"v_{c}").alias(f"hi_{c}") for c in FIELDS])
    differ = F.filter(F.array(*[F.when(F.col(f"lo_{c}") != F.col(f"hi_{c}"), F.lit(c)) for c in FIELDS]), lambda c: c.isNotNull())
    ends = cut(ends.select("gid", "vid", "n_entries", differ.alias("_open"), *[F.when(F.col(f"lo_{c}") == F.col(f"hi_{c}"), F.col(f"lo_{c}")).alias(f"v_{c}") for c in FIELDS]))
    contested = ends.where(F.size("_open") > 0)
    values = cut(field_values(salted_join(rows, contested.select("gid", "_open"), ["gid"]), F.col("_open")))
    agreed = consensus_values(values).withColumnRenamed("value", "_consensus")
    far = F.levenshtein(F.col("value"), F.col("_consensus"))
    late = F.coalesce(F.unix_micros(F.col("latest").cast("timestamp")), F.lit(0))
    closest = salted_join(values, agreed, ["gid", "field"]).groupBy("gid", "field").agg(F.min_by("value", F.struct((F.col("value") != F.col("_consensus")), far.alias("_d"), (-F.col("weight")).alias("_w"), (-late).alias("_l"), "value")).alias("value"))
    chosen = closest.groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_v"))
    typed = [F.coalesce(F.col(f"v_{c}"), F.col("_v")[c]).cast(kind(c)).alias(c) for c in FIELDS]
    return lone.unionByName(ends.join(chosen, "gid", "left").select("vid", "n_entries", *typed))
