"""Column names and constants of a panel, passed to every operator.

The reference scripts hard-code one panel (watershed x month).  Here every name
and limit is a field, and ``ANALOGUE`` holds the values for the panel derived
from the TPC-H-like test tables (``panelcast.sources.panel``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class PanelSpec:
    unit: str = "unit"
    year: str = "year"
    month: str = "month"
    wyear: str = "wyear"
    target: str = "target_a"
    cover: str = "cover"
    features: tuple[str, ...] = ()
    # cohort rules
    sum_cut: float = 2000.0          # keep (unit, year) when strict sum(target) >= sum_cut
    cover_cut: float = 50.0          # keep (unit, year) when strict mean(cover) >=/< cover_cut
    split_year: int = 1999           # train: wyear <= split_year, test: wyear > split_year
    fold_base: int = 1994            # fold = wyear - fold_base
    scenario_start: int = 2010       # scenario rows kept when wyear > scenario_start
    drought_years: tuple[int, ...] = (1996, 1997, 2000)
    nondrought_years: tuple[int, ...] = (1995, 1998, 1999, 2001)
    excluded_units: tuple[int, ...] = (1, 4, 7)
    seed: int = 160617

    def with_target(self, target: str) -> "PanelSpec":
        return replace(self, target=target)


# Fixed values of the analogue panel (mapping of the reference's constants):
#   consumptive target -> target_a, power target -> target_b, forest share -> cover
#   sum cut 1000 -> 2000, forest cut 20 -> 50, split year 2019 -> 1999, fold base 2010 -> 1994
#   drought years {2012..2015, 2020..2022} -> {1996, 1997, 2000}
#   non-drought years {2011, 2016..2019, 2023} -> {1995, 1998, 1999, 2001}
#   excluded basins -> units 1, 4, 7; scenario start year 2010 (scenario years are shifted)
FOREST_FEATURES = ("tax", "lines", "size", "price", "bal", "nation", "project", "wyear", "month")
SEARCH_FEATURES = ("date_num", "wyear", "month", "quarter", "tax", "lines", "size", "price",
                   "bal", "nation", "project")

ANALOGUE = PanelSpec(features=FOREST_FEATURES)
ANALOGUE_B = ANALOGUE.with_target("target_b")


@dataclass(frozen=True)
class ForestParams:
    ntree: int = 1000
    mtry: int = 4
    fraction: float = 0.632
    minsplit: int = 20
    minbucket: int = 7
    max_depth: int = 61          # 61: no limit (a deeper tree raises); less: stop there
    seed: int = 160617
    # trees are grown in batches so one level's shuffle stays bounded
    tree_batch: int = 250
    # a node of at most so many rows (in bag and out) is finished by one task; larger ones grow level by level
    subtree_rows: int = 1_500_000
    # value blocks of the cut search (approximate quantiles per feature): no window holds a node's values
    blocks: int = 256
