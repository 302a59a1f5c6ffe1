"""Incremental pipeline: stages with versions, seals per unit, and what is stale."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """A step: what it needs, on which units it works, and what its result depends on."""

    name: str
    scope: str
    needs: tuple[str, ...] = ()
    version: int = 1
    settings: dict = field(default_factory=dict, hash=False)

    @property
    def signature(self) -> str:
        """Version and sixteen hex digits over the settings."""
        text = json.dumps(self.settings, sort_keys=True, ensure_ascii=False)
        return f"{self.version}:{hashlib.sha256(text.encode()).hexdigest()[:16]}"


class Registry:
    """Stages in an order in which every stage follows what it needs."""

    def __init__(self, stages: list[Stage]):
        seen: set[str] = set()
        for s in stages:
            if missing := set(s.needs) - seen:
                raise ValueError(f"{s.name} needs {sorted(missing)}, which no stage before it makes")
            seen.add(s.name)
        self.stages = {s.name: s for s in stages}

    def downstream(self, names: set[str]) -> list[str]:
        """The stages and all that depend on them, in order."""
        out = set(names)
        for s in self.stages.values():
            if out & set(s.needs):
                out.add(s.name)
        return [n for n in self.stages if n in out]

    def reach(self, held: dict[str, str] | None = None) -> list[tuple[str, str, str]]:
        """(from, to, how): what a stage that isn't current makes stale, over any number of steps.

        `same` reaches the same unit, `up` the unit that holds it (`held` names the scope that
        holds another, as pages are held by files), `all` every unit.
        """
        held = held or {}
        ways: dict[str, dict[str, set[str]]] = {}
        for s in self.stages.values():
            mine: dict[str, set[str]] = {"same": set(), "up": set(), "all": set()}
            for need in s.needs:
                n, theirs = self.stages[need], ways[need]
                if n.scope == s.scope:
                    mine["same"] |= {need} | theirs["same"]
                    mine["up"] |= theirs["up"]
                    mine["all"] |= theirs["all"]
                elif held.get(n.scope) == s.scope:
                    mine["up"] |= {need} | theirs["same"]
                    mine["all"] |= theirs["up"] | theirs["all"]
                else:
                    mine["all"] |= {need} | theirs["same"] | theirs["up"] | theirs["all"]
            ways[s.name] = mine
        return [(f, to, how) for to, mine in ways.items() for how, names in mine.items() for f in sorted(names)]


def latest_seals(seals: DataFrame) -> DataFrame:
    """The last seal of each stage and unit."""
    w = W.partitionBy("stage", "unit").orderBy(F.desc("sealed_at"), F.desc("signature"))
    return seals.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def unit_states(units: DataFrame, seals: DataFrame, registry: Registry, holders: DataFrame | None = None, held: dict[str, str] | None = None) -> DataFrame:
    """stage, unit, state: `current`, `stale`, `failed` or `never`.

    `units`: stage, unit. A seal of another signature, or an invalid one, is stale. So is a unit
    if a stage that its own needs, near or far, isn't current: for the same unit within a
    scope; for any unit that it holds where `held` says which scope holds which and `holders`
    (unit, holder) which unit holds which; else for any unit at all. The plan has two joins by
    unit and two by short lists, however many stages there are.
    """
    spark = units.sparkSession
    wanted = spark.createDataFrame([(s.name, s.signature) for s in registry.stages.values()], "stage string, wanted string")
    own = (
        units.join(F.broadcast(wanted), "stage").join(latest_seals(seals).select("stage", "unit", "signature", F.col("state").alias("sealed")), ["stage", "unit"], "left")
        .withColumn("own", F.when(F.col("signature").isNull(), "never").when(F.col("sealed") == "failed", "failed")
            .when((F.col("sealed") == "invalid") | (F.col("signature") != F.col("wanted")), "stale").otherwise("current"))
        .select("stage", "unit", F.col("own").alias("state"))
    )
    # At most the square of the number of stages.
    pairs = F.broadcast(spark.createDataFrame(registry.reach(held if holders is not None else None), "stage string, to string, how string"))
    bad = own.where("state <> 'current'").select("stage", "unit").join(pairs, "stage")
    hit = bad.where("how = 'same'").select(F.col("to").alias("stage"), "unit")
    if holders is not None:
        up = bad.where("how = 'up'").select(F.col("to").alias("stage"), "unit").distinct()
        hit = hit.unionByName(up.join(holders.select("unit", "holder"), "unit").select("stage", F.col("holder").alias("unit")))
    hit = hit.distinct().withColumn("hit", F.lit(True))
    everywhere = bad.where("how = 'all'").select(F.col("to").alias("stage")).distinct().withColumn("all_hit", F.lit(True))
    inherits = (F.col("state") == "current") & F.coalesce("hit", "all_hit", F.lit(False))
    return own.join(hit, ["stage", "unit"], "left").join(everywhere, "stage", "left").select("stage", "unit", F.when(inherits, "stale").otherwise(F.col("state")).alias("state"))


def seals_for(units: DataFrame, stage: Stage, outcome: str, at: str) -> DataFrame:
    """The seals of a stage's units (unit) after a run: stage, unit, signature, state, sealed_at."""
    return units.select(
        F.lit(stage.name).alias("stage"), "unit", F.lit(stage.signature).alias("signature"), F.lit(outcome).alias("state"), F.lit(at).cast("timestamp").alias("sealed_at")
    )


def invalidate(seals: DataFrame, registry: Registry, names: set[str], at: str) -> DataFrame:
    """The seals with an invalid one on top for every unit of the stages and of all that depend on them."""
    hit = registry.downstream(names)
    over = latest_seals(seals).where(F.col("stage").isin(*hit)).withColumn("state", F.lit("invalid")).withColumn("sealed_at", F.lit(at).cast("timestamp"))
    return seals.unionByName(over.select(*seals.columns))


def run_stale(
    states: DataFrame, registry: Registry, work: dict[str, Callable[[DataFrame], None]], at: str, cancelled: Callable[[], bool] = lambda: False
) -> list[tuple[str, str, str]]:
    """Run each stage on its units that aren't current; (stage, signature, outcome) as sealed.

    `work` gets the units as a DataFrame and writes its own output. A stage that fails is
    sealed `failed` and the stages that need it are left for the next run; a later stage over
    whole cases, which may have missed what failed, is sealed `partial`. `cancelled` is asked
    before each stage.
    """
    sealed, broken = [], set()
    for name, stage in registry.stages.items():
        if cancelled():
            break
        if name not in work or broken & set(stage.needs):
            broken |= {name} if broken & set(stage.needs) else set()
            continue
        units = states.where((F.col("stage") == name) & (F.col("state") != "current")).select("unit")
        if not units.limit(1).count():
            continue
        try:
            work[name](units)
            sealed.append((name, stage.signature, "partial" if broken and stage.scope == "case" else "done"))
        except Exception:  # one stage's failure must not lose the others' work
            broken.add(name)
            sealed.append((name, stage.signature, "failed"))
    return sealed
