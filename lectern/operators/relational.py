"""Dataset management as joins and filters (JN5-JN7, FLT5, FLT6, FLT10, SRC3, SRC8, SRC9, SRC11)."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.ranking import dense_position
from lectern.schemas import MAIN_CONFERENCES, SUB_CONFERENCES


def enrich(left: DataFrame, extras: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """JN5 / MAP1 struct form: left join, fields of ``extras`` overwrite the left
    ones where present; a missing extra leaves the row unchanged."""
    keys = [on] if isinstance(on, str) else list(on)
    shared = [c for c in extras.columns if c in left.columns and c not in keys]
    new = [c for c in extras.columns if c not in left.columns]
    r = extras.select(*keys, *[F.col(c).alias(f"_x_{c}") for c in shared], *new)
    j = left.join(r, keys, "left")
    return j.select(*[F.coalesce(F.col(f"_x_{c}"), F.col(c)).alias(c) if c in shared else F.col(c)
                      for c in left.columns], *new)


def add_if_absent(loaded: DataFrame, new: DataFrame, name: str = "dataset") -> DataFrame:
    """JN6: append the datasets of ``new`` whose name is not loaded yet."""
    names = loaded.select(F.col(name).alias("_loaded")).distinct()
    return loaded.unionByName(new.join(names, new[name].eqNullSafe(names["_loaded"]), "left_anti"))


def remove_datasets(papers: DataFrame, substring: str | None = None, names: Iterable[str] = (),
                    name: str = "dataset") -> DataFrame:
    """FLT6/SET4: drop datasets whose name contains ``substring`` and those listed."""
    out = papers
    if substring:
        out = out.filter(~F.coalesce(F.col(name).contains(substring), F.lit(False)))
    lst = list(names)
    if lst:
        out = out.filter(~F.coalesce(F.col(name).isin(lst), F.lit(False)))
    return out


def lookup(papers: DataFrame, dataset: str, key) -> DataFrame:
    """FLT5: one paper by (dataset, key); pushed to the scan as equality filters."""
    return papers.filter((F.col("dataset") == dataset) & (F.col("paper_key") == F.lit(key)))


def route_folder(name: str | Column) -> Column:
    """SRC3: names holding four digits live with the conferences, others with searches."""
    n = F.col(name) if isinstance(name, str) else name
    return F.when(n.rlike(r"\d{4}"), F.lit("conferences")).otherwise(F.lit("searches"))


def dataset_class(name: str | Column) -> Column:
    """SRC9: ``{YEAR}_{CONF}`` -> main / sub / other by the conference part."""
    n = F.col(name) if isinstance(name, str) else name
    conf = F.try_element_at(F.split(F.regexp_replace(n, r"\.[^.]*$", ""), "_"), F.lit(2))
    return (F.when(conf.isin(list(MAIN_CONFERENCES)), F.lit("main"))
            .when(conf.isin(list(SUB_CONFERENCES)), F.lit("sub"))
            .otherwise(F.lit("other")))


def catalog(entries: DataFrame, folder_order: str = "folder_ord", name: str = "name",
            is_file: str = "is_file") -> DataFrame:
    """SRC8/SRT4: catalog entries numbered in (folder, directories first,
    lower-case name) order, 0-based running index across folders.  Hidden names
    (leading ``.``) are skipped.  The numbering is a range-partitioned position,
    so even a very large catalog is not funnelled into one task."""
    visible = entries.filter(~F.col(name).startswith(".")).withColumn("_all", F.lit(0))
    keyed = visible.withColumn("_lname", F.lower(F.col(name)))
    return dense_position(keyed, "_all", [folder_order, is_file, "_lname", name], out="idx").drop("_all", "_lname")


def select_by_index(catalog_df: DataFrame, selected: DataFrame, idx: str = "idx") -> DataFrame:
    """JN7: selected indices -> catalog rows (status ``ok``); unknown indices are
    reported with status ``invalid`` (anti join), not raised."""
    sel = selected.select(F.col(idx)).distinct()
    ok = sel.join(catalog_df, idx, "inner").withColumn("status", F.lit("ok"))
    bad = (sel.join(catalog_df.select(idx), idx, "left_anti")
           .select(idx, *[F.lit(None).cast(catalog_df.schema[c].dataType).alias(c)
                          for c in catalog_df.columns if c != idx])
           .withColumn("status", F.lit("invalid")))
    return ok.unionByName(bad)


def expected_grid(conferences: DataFrame, conf_col: str, first_year: Column, last_year: Column) -> DataFrame:
    """SRC11/JN11: every (year, conference) pair, generated per conference row
    by exploding a year sequence (bounds are scalar subqueries), not a join."""
    return conferences.select(F.col(conf_col).alias("conference"),
                              F.explode(F.sequence(first_year, last_year)).alias("year"))
