"""Taking out everything that hangs from some rows, keeping it, and putting it back."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut_lineage


class Link(NamedTuple):
    """Rows of `child` hang from rows of `parent` where `foreign` equals `key`."""

    parent: str
    key: str
    child: str
    foreign: str


def hanging(tables: dict[str, DataFrame], keys: dict[str, str], links: list[Link], roots: dict[str, DataFrame], most_rounds: int = 50) -> dict[str, DataFrame]:
    """Per table the keys of all rows that hang from the root rows, over any number of links and cycles of them.

    `keys` names the unique column of each table, `roots` has that column of the rows to start
    from. Rounds of semi-joins go on until none finds a new row; if they don't end, it raises.
    Rows without key can't hang from anything.
    """
    found = {t: (roots[t].select(keys[t]).where(F.col(keys[t]).isNotNull()).distinct() if t in roots else tables[t].select(keys[t]).limit(0)) for t in tables}
    fresh = dict(found)
    for _ in range(most_rounds):
        after: dict[str, DataFrame] = {}
        for t in tables:
            met = None
            for link in links:
                if link.child != t or link.parent not in fresh:
                    continue
                parents = tables[link.parent].join(fresh[link.parent], keys[link.parent], "left_semi").select(F.col(link.key).alias(link.foreign)).distinct()
                rows = tables[t].join(parents, link.foreign, "left_semi").select(keys[t])
                met = rows if met is None else met.unionByName(rows)
            if met is None:
                continue
            new = cut_lineage(met.where(F.col(keys[t]).isNotNull()).distinct().join(found[t], keys[t], "left_anti"))
            if new.limit(1).count():
                after[t] = new
        if not after:
            return found
        found |= {t: cut_lineage(found[t].unionByName(new)) for t, new in after.items()}
        fresh = after
    raise RuntimeError(f"what hangs from the rows was not complete after {most_rounds} rounds")


def digest(df: DataFrame) -> tuple[int, int]:
    """Number and checksum of the rows, whatever their order."""
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return int(r.n), int(r.h)


def take_out(tables: dict[str, DataFrame], keys: dict[str, str], found: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, tuple[int, int]]]:
    """(what stays, what was taken, the digests of what was taken) per table."""
    taken = {t: cut_lineage(df.join(found[t], keys[t], "left_semi")) for t, df in tables.items()}
    return {t: df.join(found[t], keys[t], "left_anti") for t, df in tables.items()}, taken, {t: digest(df) for t, df in taken.items()}


def put_back(tables: dict[str, DataFrame], keys: dict[str, str], taken: dict[str, DataFrame], digests: dict[str, tuple[int, int]]) -> dict[str, DataFrame]:
    """The tables with what was taken; raises if that changed meanwhile or its keys are in use again."""
    for t, df in taken.items():
        if digest(df) != tuple(digests[t]):
            raise ValueError(f"what was taken from {t} isn't what was put away")
        if tables[t].join(df.select(keys[t]), keys[t], "left_semi").limit(1).count():
            raise ValueError(f"{t} has rows under the keys that were taken out")
    return {t: df.unionByName(taken[t]) if t in taken else df for t, df in tables.items()}
