"""Operators that are plugged in by name: what a source, a model, a judge or a spec writer does to rows.

A hook is a column expression or a function over Arrow batches.  One that is absent gives null, so that what does not
depend on it still runs; one that is gated raises, with its reason, as soon as a plan names it.

    HOOKS = Hooks()
    HOOKS.add("judge", "length", column=lambda text: F.length(text) < 20)
    HOOKS.add("predict", "tiny", arrow=run_model, takes=["text"])
    HOOKS.add("predict", "big", gate=lambda: None if have_weights() else "no weights")
    HOOKS.applied(df, "judge", "length", ["text"])        # df with a boolean column `judge`
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each kind of hook gives for a row.
KINDS = {"verify": "boolean", "acquire": "array<string>", "predict": "string", "judge": "boolean", "spec": "string"}


class Gated(RuntimeError):
    """A hook that is known, but may not run here."""


@dataclass(frozen=True)
class Hook:
    kind: str
    name: str
    column: Callable[..., Column] | None = None
    arrow: Callable[[pa.RecordBatch], pa.Array] | None = None  #: the inputs' columns -> the results, in order
    gate: Callable[[], str | None] | None = None  #: why it may not run, or None


@dataclass
class Hooks:
    known: dict[tuple[str, str], Hook] = field(default_factory=dict)

    def add(self, kind: str, name: str, column=None, arrow=None, gate=None) -> Hook:
        if kind not in KINDS:
            raise ValueError(f"hooks are of the kinds {sorted(KINDS)}, not {kind}")
        if (column is None) == (arrow is None) and gate is None:
            raise ValueError("a hook is a column expression or a function over batches")
        if (kind, name) in self.known:
            raise ValueError(f"{kind} {name} is there already")
        self.known[kind, name] = Hook(kind, name, column, arrow, gate)
        return self.known[kind, name]

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self.known if k == kind)

    def reason(self, kind: str, name: str) -> str | None:
        """Why the hook gives nothing: null if it runs."""
        hook = self.known.get((kind, name))
        return "absent" if hook is None else hook.gate() if hook.gate else None

    def applied(self, df: DataFrame, kind: str, name: str, inputs: list[str], out: str | None = None) -> DataFrame:
        """df with the hook's result as the column `out` (the kind's name, unless given)."""
        out, kind_type, hook = out or kind, KINDS[kind], self.known.get((kind, name))
        if hook is None:
            return df.withColumn(out, F.lit(None).cast(kind_type))
        if hook.gate and (why := hook.gate()):
            raise Gated(f"{kind} {name}: {why}")
        if hook.column:
            return df.withColumn(out, hook.column(*[F.col(c) for c in inputs]).cast(kind_type))
        if out in df.columns:
            df = df.drop(out)
        run, schema = hook.arrow, df.select("*", F.lit(None).cast(kind_type).alias(out)).schema
        at = [df.columns.index(c) for c in inputs]

        def over(batches):
            for batch in batches:
                found = run(pa.record_batch([batch.column(i) for i in at], inputs))
                if len(found) != batch.num_rows:
                    raise ValueError(f"{kind} {name} gave {len(found)} results for {batch.num_rows} rows")
                yield pa.record_batch([*batch.columns, found], [*batch.schema.names, out])

        return df.mapInArrow(over, schema)

    def all_of(self, df: DataFrame, kind: str, names: list[str], inputs: list[str]) -> DataFrame:
        """df once for each name, with columns `<kind>_name`, the result, and `<kind>_reason`; gated and absent hooks give null with their reason."""
        parts = []
        for name in names:
            why = self.reason(kind, name)
            done = df.withColumn(kind, F.lit(None).cast(KINDS[kind])) if why else self.applied(df, kind, name, inputs)
            parts.append(done.withColumn(f"{kind}_name", F.lit(name)).withColumn(f"{kind}_reason", F.lit(why).cast("string")))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
