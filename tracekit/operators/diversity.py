"""How far each plan is from the earlier plans of its evaluation run.

The history starts empty with each run, and a run is a bounded number of plans, so the work grows
with the number of runs. Inside a run, term weights are refitted for every plan on the plans up to it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tracekit.functions import plan_text as PT


def diversity_prior(plans: DataFrame, key: str, run: str, place: str, text: str) -> DataFrame:
    """One row per plan, ``key, run, diversity``: 1 - the largest TF-IDF cosine to an earlier plan of its ``run``.

    ``place`` orders a run's plans. The first plan of a run has 1.0. A plan without a term has cosine 0 to all
    others; while no plan of the run had a term, null and empty texts included, the value is 0.5.
    A run has to be bounded (one task holds its term counts, not its texts).
    """
    terms = PT.tokens(text)
    rows = plans.select(key, run, place, terms.alias("terms"))
    schema = f"{key} {plans.schema[key].dataType.simpleString()}, {run} {plans.schema[run].dataType.simpleString()}, diversity double"

    def one_run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(place, kind="stable")
        lists = [[] if t is None else list(t) for t in group["terms"]]
        plan = np.repeat(np.arange(len(lists)), [len(t) for t in lists])
        term = pd.factorize(np.array([x for t in lists for x in t], dtype=object))[0]
        # postings (plan, term, count), by plan
        width = int(term.max()) + 1 if len(term) else 1
        code, count = np.unique(plan * width + term, return_counts=True)
        plan, term, count = code // width, code % width, count.astype(float)
        ends = np.searchsorted(plan, np.arange(len(lists)), "right")
        held, mine, out = np.zeros(width), np.zeros(width), np.empty(len(lists))
        start = 0
        for k, end in enumerate(ends):
            held[term[start:end]] += 1
            if k == 0:
                out[k] = 1.0
            elif end == 0:
                out[k] = 0.5
            else:
                idf2 = (np.log((2.0 + k) / (1.0 + held)) + 1.0) ** 2
                mine[term[start:end]] = count[start:end]
                dot = np.bincount(plan[:start], count[:start] * (mine * idf2)[term[:start]], k)
                size = np.bincount(plan[:start], count[:start] ** 2 * idf2[term[:start]], k)
                own = (count[start:end] ** 2 * idf2[term[start:end]]).sum()
                with np.errstate(divide="ignore", invalid="ignore"):
                    cosine = np.where((size > 0) & (own > 0), dot / np.sqrt(size * own), 0.0)
                out[k] = max(1.0 - cosine.max(), 0.0)
                mine[term[start:end]] = 0.0
            start = end
        return pd.DataFrame({key: group[key].to_numpy(), run: group[run].to_numpy(), "diversity": out})

    return rows.groupBy(run).applyInPandas(one_run, schema)
