"""Feature views, on-demand views and services.

A `FeatureView` is metadata around a source DataFrame: join key, event
timestamp, optional created timestamp, TTL and the declared feature fields.
Retrieval is plain DataFrame work: `historical` is the bucketed as-of join,
`online` a left join to the latest-row table. On-demand views are applied
after retrieval and fed by request-time columns that the entity DataFrame carries: functions
DataFrame -> DataFrame of built-in expressions (`OnDemandView`), or functions of
Arrow batches with a declared output schema (`BatchOnDemandView`).

A feature keeps its name; where two retrieved views have a feature of one name, or an entity
column has it, it is called `<view>__<feature>`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stockpulse.operators.pointintime import DAY, as_of_join, latest_per_key, online_lookup

_TYPES = {"long": T.LongType, "int": T.IntegerType, "float": T.FloatType, "double": T.DoubleType,
          "string": T.StringType, "timestamp": T.TimestampType}


@dataclass(frozen=True)
class Entity:
    name: str
    join_key: str


@dataclass
class FeatureView:
    name: str
    entity: Entity
    source: DataFrame
    timestamp_field: str
    fields: dict[str, str]                 # feature name -> declared type name
    ttl_seconds: int | None = DAY
    created_field: str | None = None
    tags: dict[str, str] = field(default_factory=dict)
    online: bool = True

    def check_schema(self) -> list[str]:
        """Declared fields vs the source: missing columns and type
        mismatches (numeric widening is allowed)."""
        problems = []
        have = {f.name: f.dataType for f in self.source.schema.fields}
        for col in [self.entity.join_key, self.timestamp_field] + list(self.fields):
            if col not in have:
                problems.append(f"{self.name}: missing column {col}")
        for name, tname in self.fields.items():
            if name in have and not _compatible(have[name], _TYPES[tname]()):
                problems.append(f"{self.name}: {name} declared {tname}, source {have[name].simpleString()}")
        return problems

    def features(self, names: list[str] | None = None) -> list[str]:
        return list(self.fields) if names is None else names


def _compatible(actual: T.DataType, declared: T.DataType) -> bool:
    if type(actual) is type(declared):
        return True
    num = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    return isinstance(actual, num) and isinstance(declared, num)


@dataclass
class OnDemandView:
    """L1: features computed from retrieved features + request columns."""
    name: str
    sources: list[str]                     # names of feature views it reads
    request_columns: list[str]
    fn: Callable[[DataFrame], DataFrame]   # adds the output columns
    outputs: list[str]


@dataclass
class BatchOnDemandView:
    """L1, vectorised: `batch_fn` takes an Arrow batch of the source features and request columns and
    returns the output columns, by name, in the declared types."""
    name: str
    sources: list[str]
    request_columns: list[str]
    batch_fn: Callable[[pa.RecordBatch], dict[str, pa.Array]]
    output_types: dict[str, str]           # output name -> declared type name
    inputs: list[str] = field(default_factory=list)     # columns the function reads; all if empty

    @property
    def outputs(self) -> list[str]:
        return list(self.output_types)

    def fn(self, df: DataFrame) -> DataFrame:
        added = T.StructType([T.StructField(n, _TYPES[t]()) for n, t in self.output_types.items()])
        wanted = self.inputs or df.columns
        declared = to_arrow_schema(added)
        return df.mapInArrow(_batch_runner(self.name, self.batch_fn, wanted, declared),
                             T.StructType([*df.schema.fields, *added.fields]))


def _batch_runner(name: str, fn, inputs: list[str], declared: pa.Schema):
    def run(batches):
        for batch in batches:
            got = fn(batch.select(inputs))
            if set(got) != set(declared.names):
                raise ValueError(f"{name}: returned columns {sorted(got)}, declared {sorted(declared.names)}")
            for f in declared:
                col = got[f.name]
                if col.type != f.type or len(col) != batch.num_rows:
                    raise ValueError(f"{name}: {f.name} is {len(col)} x {col.type}, declared {batch.num_rows} x {f.type}")
            yield pa.RecordBatch.from_arrays([*batch.columns, *[got[n] for n in declared.names]],
                                             [*batch.schema.names, *declared.names])
    return run


@dataclass
class FeatureService:
    """C11: a named list of feature references across views."""
    name: str
    refs: list[str]                        # "view:feature" or "view" (all) or an on-demand view name


class FeatureRegistry:
    def __init__(self):
        self.views: dict[str, FeatureView] = {}
        self.on_demand: dict[str, OnDemandView | BatchOnDemandView] = {}
        self.services: dict[str, FeatureService] = {}

    def apply(self, *objs) -> FeatureRegistry:
        for o in objs:
            if isinstance(o, FeatureView):
                probs = o.check_schema()
                if probs:
                    raise ValueError("; ".join(probs))
                self.views[o.name] = o
            elif isinstance(o, (OnDemandView, BatchOnDemandView)):
                self.on_demand[o.name] = o
            elif isinstance(o, FeatureService):
                self.services[o.name] = o
            else:
                raise TypeError(type(o))
        return self

    def resolve(self, refs: list[str] | str) -> tuple[dict[str, list[str]], list[str]]:
        """C10: 'view:feature' references (or a service name) ->
        ({view: [features]}, [on-demand views])."""
        if isinstance(refs, str):
            refs = self.services[refs].refs
        per_view: dict[str, list[str]] = {}
        odv: list[str] = []
        for r in refs:
            if r in self.on_demand:
                odv.append(r)
                for src in self.on_demand[r].sources:
                    per_view.setdefault(src, [])
                continue
            view, _, feat = r.partition(":")
            if view not in self.views:
                raise KeyError(f"unknown feature view {view}")
            feats = [feat] if feat else list(self.views[view].fields)
            for f in feats:
                if f not in self.views[view].fields:
                    raise KeyError(f"unknown feature {view}:{f}")
            lst = per_view.setdefault(view, [])
            lst += [f for f in feats if f not in lst]
        return per_view, odv

    def _odv_inputs(self, per_view, odv):
        need = {v: list(fs) for v, fs in per_view.items()}
        for name in odv:
            for src in self.on_demand[name].sources:
                need[src] = list(dict.fromkeys(need.get(src, []) + list(self.views[src].fields)))
        return need

    def _names(self, need, base_cols) -> dict[tuple[str, str], str]:
        """(view, feature) -> output name."""
        base = {c.lower() for c in base_cols}
        times: dict[str, int] = {}
        for feats in need.values():
            for f in feats:
                times[f.lower()] = times.get(f.lower(), 0) + 1
        return {(v, f): f if times[f.lower()] == 1 and f.lower() not in base else f"{v}__{f}"
                for v, feats in need.items() for f in feats}

    def historical(self, entity_df: DataFrame, refs, entity_ts: str = "event_timestamp",
                   bucket_seconds: int | None = None) -> DataFrame:
        """E5: point-in-time correct training frame for `entity_df`. Buckets adapt to hot keys
        unless a width is given."""
        per_view, odv = self.resolve(refs)
        need = self._odv_inputs(per_view, odv)
        out = entity_df
        for i, (vname, feats) in enumerate(need.items()):
            v = self.views[vname]
            out = as_of_join(out, v.source, v.entity.join_key, entity_ts, v.timestamp_field, feats,
                             v.ttl_seconds, v.created_field, bucket_seconds, prefix=f"__{i}_")
        return self._finish(out, entity_df.columns, per_view, odv, need)

    def online(self, entity_df: DataFrame, refs, latest: dict[str, DataFrame] | None = None) -> DataFrame:
        """Latest value per key; unknown keys get NULL features."""
        per_view, odv = self.resolve(refs)
        need = self._odv_inputs(per_view, odv)
        out = entity_df
        for i, (vname, feats) in enumerate(need.items()):
            v = self.views[vname]
            tbl = (latest or {}).get(vname)
            if tbl is None:
                tbl = latest_per_key(v.source, v.entity.join_key, v.timestamp_field, feats, v.created_field)
            out = online_lookup(out, tbl.select(v.entity.join_key, *[F.col(f).alias(f"__{i}_{f}") for f in feats]),
                                v.entity.join_key)
        return self._finish(out, entity_df.columns, per_view, odv, need)

    def _finish(self, out, base_cols, per_view, odv, need):
        names = self._names(need, base_cols)
        out = out.select(*[F.col(f"`{c}`") for c in base_cols],
                         *[F.col(f"`__{i}_{f}`").alias(names[v, f]) for i, (v, feats) in enumerate(need.items()) for f in feats])
        for name in odv:
            out = self.on_demand[name].fn(out)
        keep = list(base_cols) + [names[v, f] for v, fs in per_view.items() for f in fs]
        keep += [o for name in odv for o in self.on_demand[name].outputs]
        return out.select(*[F.col(f"`{c}`") for c in dict.fromkeys(keep)])
