"""Control folds over time series: PID, heater duty, sensor words, latest status."""
from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

LEAST_DT = 0.001


@dataclass(frozen=True)
class Gains:
    kp: float = 5.0
    ki: float = 0.007
    kd: float = 1.0
    i_min: float = -1000.0
    i_max: float = 1000.0
    out_min: float = 0.0
    out_max: float = 100.0


#: Gains of the older controller, which takes its sampling time as it is.
LEGACY_GAINS = Gains(2.0, 10.0, 0.001)


@dataclass
class PID:
    """One controller; the integral is clamped at each step, so its fold has no shortcut."""

    gains: Gains = Gains()
    integral: float = 0.0
    last_error: float = 0.0

    def step(self, error: float, dt: float) -> float:
        g = self.gains
        dt = dt if dt > 0 else LEAST_DT
        self.integral = min(max(self.integral + error * dt, g.i_min), g.i_max)
        slope = (error - self.last_error) / dt
        self.last_error = error
        return min(max(g.kp * error + g.ki * self.integral + g.kd * slope, g.out_min), g.out_max)

    def reset(self) -> None:
        self.integral = self.last_error = 0.0

    def update(self, **changed: float) -> None:
        """New values for some of the gains and limits; the others and the state stay."""
        self.gains = replace(self.gains, **{k: v for k, v in changed.items() if v is not None})


def seconds_between(ts: str, order: Window) -> Column:
    """Seconds since the key's previous row (microsecond exact); 0 for the first."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.coalesce((us - F.lag(us).over(order)) / 1e6, F.lit(0.0))


def guarded(dt: Column) -> Column:
    return F.when(dt > 0, dt).otherwise(F.lit(LEAST_DT))


def pid_unclamped(series: DataFrame, key: str, order: list[str], error: str, dt: str, gains: Gains) -> DataFrame:
    """Adds ``output`` without any clamp: a running sum and a lag."""
    w = Window.partitionBy(key).orderBy(*order)
    step = guarded(F.col(dt))
    total = F.sum(F.col(error) * step).over(w.rowsBetween(Window.unboundedPreceding, 0))
    slope = (F.col(error) - F.coalesce(F.lag(error).over(w), F.lit(0.0))) / step
    return series.withColumn("output", F.lit(gains.kp) * F.col(error) + F.lit(gains.ki) * total + F.lit(gains.kd) * slope)


def pid_clamped(series: DataFrame, key: str, order: list[str], error: str, dt: str, gains: Gains, least_dt: float | None = LEAST_DT) -> DataFrame:
    """(key, order, output): the clamped controller, folded in order for each key.

    A clamp after each step cannot be combined, so a key's rows pass one task in order; it keeps the state
    of one key and a batch, however long the series.  Steps under ``least_dt`` count as that long; None takes
    them as they are.  A row without an error has no output and changes nothing.
    """
    g = gains
    step = F.col(dt).cast("double") if least_dt is None else F.when(F.col(dt) > 0, F.col(dt)).otherwise(F.lit(least_dt)).cast("double")
    rows = series.select(key, *order, F.col(error).cast("double").alias("_e"), step.alias("_dt"))

    def run(batches):
        at, total, before = None, 0.0, 0.0
        for b in batches:
            out = []
            for k, e, t in zip(b.column(0).to_pylist(), b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if k != at:
                    at, total, before = k, 0.0, 0.0
                if e is None:
                    out.append(None)
                    continue
                total = min(max(total + e * t, g.i_min), g.i_max)
                out.append(min(max(g.kp * e + g.ki * total + g.kd * ((e - before) / t), g.out_min), g.out_max))
                before = e
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out, pa.float64())], names=[*b.schema.names[:-2], "output"])

    schema = StructType([*rows.schema.fields[:-2], StructField("output", DoubleType())])
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def duty_phases(power: Column, cycle_s: float, least_s: float) -> Column:
    """array<struct<state, seconds>> of a heater cycle; power is clamped to 0..100.

    A phase shorter than the least switching time is left out.
    """
    p = F.least(F.greatest(power, F.lit(0.0)), F.lit(100.0))
    on = p / 100.0 * cycle_s
    off = F.lit(cycle_s) - on
    phase = lambda name, s: F.struct(F.lit(name).alias("state"), s.alias("seconds"))
    return F.filter(F.array(phase("on", on), phase("off", off)), lambda x: x["seconds"] > least_s)


def hot_junction(word: Column, compat: bool = False) -> Column:
    """Degrees of bits 18-31, quarter steps, two's complement; ``compat`` leaves the sign bit unread."""
    v = F.shiftright(word.cast("long"), 18).bitwiseAND(F.lit(0x3FFF).cast("long"))
    return (v if compat else F.when(v >= 0x2000, v - 0x4000).otherwise(v)) * 0.25


def cold_junction(word: Column, compat: bool = False) -> Column:
    """Degrees of bits 4-15, sixteenth steps."""
    v = F.shiftright(word.cast("long"), 4).bitwiseAND(F.lit(0xFFF).cast("long"))
    return (v if compat else F.when(v >= 0x800, v - 0x1000).otherwise(v)) * 0.0625


def fault(word: Column) -> Column:
    bit = lambda i: F.shiftright(word.cast("long"), i).bitwiseAND(F.expr("cast(1 as bigint)")) == 1
    return F.when(bit(16), F.when(bit(2), "Short to VCC").when(bit(1), "Short to GND").otherwise("No Connection"))


def latest(series: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's last row: one combining aggregate."""
    top = series.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v"))
    return top.select(key, "v.*")


def readings(series: DataFrame, target: float, value: str = "value") -> DataFrame:
    """Adds ``error`` = target - reading; failed readings (null) are skipped, so the fold does not see them."""
    return series.where(F.col(value).isNotNull()).withColumn("error", F.lit(float(target)) - F.col(value))


def duty_phases_legacy(power: Column, cycle_s: float, least_s: float) -> Column:
    """The older heater cycle: power is not clamped, so a phase may outlast the cycle or be left out."""
    on = power / 100.0 * cycle_s
    phase = lambda name, s: F.struct(F.lit(name).alias("state"), s.alias("seconds"))
    return F.concat(F.when(on > least_s, F.array(phase("on", on))).otherwise(F.array().cast("array<struct<state:string,seconds:double>>")), F.when(on < cycle_s - least_s, F.array(phase("off", F.lit(cycle_s) - on))).otherwise(F.array().cast("array<struct<state:string,seconds:double>>")))


#: Kettle constants: degrees per second heating and cooling, seconds per tick, degrees per tick and
#: step of inertia, and the bounds of the inertia count.
HEAT, COOL, TICK, INERTIA, MOST, LEAST = 0.06, -0.03, 0.1, 0.0005, 60, -6


def kettle(heating: Column, ticks: Column, start: float = 0.0) -> Column:
    """Temperature after ``ticks`` of a kettle that heats or cools from ``start``.

    Inertia counts up to MOST while heating and down to LEAST while cooling; a tick adds its rate and
    its inertia as long as the temperature is below 100 (heating) or above 0 (cooling).
    """
    first = F.struct(F.lit(float(start)).alias("t"), F.lit(0).alias("n"))

    def step(s, _):
        n = F.when(heating, F.least(s["n"] + 1, F.lit(MOST))).otherwise(F.greatest(s["n"] - 1, F.lit(LEAST)))
        rate = F.when(heating, F.lit(TICK * HEAT)).otherwise(F.lit(TICK * COOL))
        moves = F.when(heating, s["t"] < 100).otherwise(s["t"] > 0)
        return F.struct(F.when(moves, s["t"] + rate + F.lit(INERTIA) * n).otherwise(s["t"]).alias("t"), n.alias("n"))

    return F.aggregate(F.sequence(F.lit(1), ticks), first, step, lambda s: s["t"])
