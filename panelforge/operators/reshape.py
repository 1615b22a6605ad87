"""Wide and text forms of genotypes.  Samples are never pivoted into columns; ids of a request list (hundreds at most) are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions import genotype as G
from panelforge.session import broadcast_if_small

MAX_PIVOT = 500


def _checked(ids: list[str]) -> list[str]:
    if len(ids) > MAX_PIVOT:
        raise ValueError(f"a request may name at most {MAX_PIVOT} ids")
    return list(dict.fromkeys(ids))


def _pivot(rows: DataFrame, by: list[str], ids: list[str], values: dict[str, Column]) -> DataFrame:
    """One row per ``by`` with the values of each id as columns; one combining aggregation, no pivot pass over the ids."""
    cols = [F.max(F.when(F.col("rsid") == i, v)).alias(f"{i}{suffix}") for i in ids for suffix, v in values.items()]
    return rows.where(F.col("rsid").isin(*ids)).groupBy(*by).agg(*cols)


def transposed(cells: DataFrame, samples: DataFrame, ids: list[str]) -> DataFrame:
    """FID, IID and the number of alternative alleles per id: -9 no call, ``.`` not assayed.  Every sample has a row."""
    ids = _checked(ids)
    wide = _pivot(cells, ["sample_id"], ids, {"": G.call_number(F.col("gt")).cast("string")})
    rows = samples.select("sample_id").distinct().join(wide, "sample_id", "left")
    return rows.select(F.col("sample_id").alias("FID"), F.col("sample_id").alias("IID"), *[F.coalesce(F.col(i), F.lit(".")).alias(i) for i in ids])


def with_confidence(rows: DataFrame, ids: list[str], by: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Per id four columns: call, ``_c`` greatest probability, ``_p`` panel, ``_alt`` alternative allele; null where there is
    no genotype."""
    return _pivot(rows, list(by), _checked(ids), {"": G.call_number(F.col("gt")), "_c": F.col("p"), "_p": F.col("assaytype"), "_alt": F.col("alt")})


def plain_calls(rows: DataFrame, ids: list[str], by: tuple[str, ...] = ("assaytype", "sample_id")) -> DataFrame:
    """Per panel and sample the calls as numbers, ids cut at the first comma."""
    return _pivot(rows.withColumn("rsid", G.first_id(F.col("rsid"))), list(by), _checked(ids), {"": G.call_number(F.col("gt"))})


def unpivoted(wide: DataFrame, id_column: str, ids: list[str]) -> DataFrame:
    """A wide genotype table as (id, rsid, value) rows; -9, NA and blank are missing and left out."""
    rows = wide.select(id_column, *[F.col(i).cast("string") for i in ids]).unpivot([id_column], ids, "rsid", "value")
    return rows.where(~F.coalesce(F.upper(F.trim("value")), F.lit("")).isin("", "NA", "-9")).withColumn("value", F.trim("value").try_cast("int"))


def _gaps_filled(entries: Column, width: Column, empty: str, separator: str, text) -> Column:
    """Entries (column, ...) in the order of their columns as one text of ``width`` parts, ``empty`` where a column has none: each
    entry brings the empty parts before it, so that the work grows with the entries."""
    before = lambda e, i: F.when(i > 0, F.element_at(entries, F.greatest(i, F.lit(1)))["column"] + 1).otherwise(0)
    parts = F.transform(entries, lambda e, i: F.concat(F.repeat(F.lit(empty + separator), e["column"] - before(e, i)), text(e)))
    end = F.coalesce(F.element_at(entries, -1)["column"], F.lit(-1))
    return F.concat(F.array_join(parts, separator), F.repeat(F.lit(separator + empty), width - 1 - end))


def record_lines(cells: DataFrame, samples: DataFrame, heads: DataFrame, genotype: Column | None = None) -> DataFrame:
    """(rsid, line): a call-file line per variant, genotypes in the order of ``samples.column`` (0-based), ``.`` where a sample
    has none.  ``heads`` has the nine fixed fields by rsid.  Where ``samples`` has panels (``assaytype``), so have ``cells``,
    ``heads`` and the result, and each panel's lines hold its own samples; otherwise the samples are those of a combined file.

    A line holds the samples by definition of the format; the genotypes of one variant are what is gathered.
    """
    text = genotype if genotype is not None else F.concat_ws(":", "gt", F.array_join(F.transform("probs", lambda p: F.format_string("%.4f", p)), ","), G.assay_tag(F.col("assaytype")))
    panel = ["assaytype"] if "assaytype" in samples.columns else []
    width = samples.groupBy(*panel).agg(F.count("*").cast("int").alias("_width"))
    placed = cells.join(samples.select(*panel, "sample_id", "column"), [*panel, "sample_id"]).select(*panel, "rsid", F.struct("column", text.alias("g")).alias("e"))
    filled = placed.groupBy(*panel, "rsid").agg(F.array_sort(F.collect_list("e")).alias("_s"))
    fixed = ["chromosome", "position", "rsid", "ref", "alt", "qual", "filter", "info", "format"]
    rows = heads.join(filled, [*panel, "rsid"])
    rows = rows.join(broadcast_if_small(width), panel) if panel else rows.withColumn("_width", F.lit(width.first()[0]))  # one row
    genos = _gaps_filled(F.col("_s"), F.col("_width"), ".", "\t", lambda e: e["g"])
    return rows.select(*panel, "rsid", F.concat_ws("\t", *[F.col(c).cast("string") for c in fixed], genos).alias("line"))


def probability_rows(cells: DataFrame, samples: DataFrame, panel: str = "assaytype") -> DataFrame:
    """(assaytype, rsid, line): the id and three probabilities for each sample of the panel in sorted order, ``0 0 0`` where it has
    none."""
    slots = samples.select(panel, "sample_id", (F.row_number().over(Window.partitionBy(panel).orderBy("sample_id")) - 1).alias("column"))  # samples of a panel, not genotypes
    width = broadcast_if_small(samples.groupBy(panel).agg(F.count("*").cast("int").alias("_width")))
    shown = F.array_join(F.transform("probs", lambda p: F.format_string("%.4f", p)), " ")
    placed = cells.join(broadcast_if_small(slots), [panel, "sample_id"]).select(panel, "rsid", F.struct("column", shown.alias("g")).alias("e"))
    have = placed.groupBy(panel, "rsid").agg(F.array_sort(F.collect_list("e")).alias("_s")).join(width, panel)
    text = _gaps_filled(F.col("_s"), F.col("_width"), "0.0000 0.0000 0.0000", " ", lambda e: e["g"])
    return have.select(panel, "rsid", F.concat_ws(" ", F.lit("---"), "rsid", text).alias("line"))


def transposed_raw(genos: DataFrame, ids: list[str], platform: str | None = None, by: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Per ``by`` and id the file's own call as a number, ``_prob`` greatest probability, ``_plat`` panel (or ``platform`` for all)
    and ``_min`` the alternative allele, no threshold applied; all blank where the sample was not assayed.  ``genos`` has
    (rsid, sample_id, file_gt, probs, assaytype, alt)."""
    there = F.col("file_gt") != "."
    plat = F.lit(platform) if platform is not None else F.col("assaytype")
    shown = lambda c: F.when(there, c)
    return _pivot(genos, list(by), _checked(ids), {"": shown(G.call_number(F.col("file_gt"))), "_prob": shown(G.top_probability(F.col("probs"))), "_plat": shown(plat), "_min": shown(F.col("alt"))})


def list_line(rows: DataFrame, column: str, order: str, max_items: int = 10_000, by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``, line): the values of a short list as one comma-separated line, a list for each ``by``; one of more than
    ``max_items`` raises an error."""
    item = F.struct(F.col(order).alias("o"), F.col(column).cast("string").alias("v"))
    if rows.groupBy(*by).count().where(F.col("count") > max_items).limit(1).count():
        raise ValueError(f"the list has more than {max_items} items")
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda e: e["v"]), ",").alias("line"))


def header_names(lines: DataFrame, separator: str = ",") -> DataFrame:
    """(place, name) of the columns that header lines (column ``value``) name, beside the other columns of ``lines``."""
    return lines.select(*[c for c in lines.columns if c != "value"], F.posexplode(F.split("value", separator)).alias("place", "name"))


def cut_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """FID and IID (both the first column) and the wanted columns in name order; unknown names are ignored."""
    first = df.columns[0]
    return df.select(F.col(first).alias("FID"), F.col(first).alias("IID"), *sorted(set(wanted) & set(df.columns[1:])))
