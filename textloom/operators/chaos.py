"""Double pendulums, one trajectory a row of start values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

G = 9.81


def _accelerations(state: np.ndarray, l1: float, l2: float, m1: float, m2: float) -> np.ndarray:
    a1, w1, a2, w2 = state
    cos, sin = np.cos(a1 - a2), np.sin(a1 - a2)
    # equations of motion as a 2 x 2 linear system in the angular accelerations
    system = np.array([[(m1 + m2) * l1, m2 * l2 * cos], [l1 * cos, l2]])
    right = np.array([-m2 * l2 * w2**2 * sin - (m1 + m2) * G * np.sin(a1), l1 * w1**2 * sin - G * np.sin(a2)])
    b1, b2 = np.linalg.solve(system, right)
    return np.array([w1, b1, w2, b2])


def trajectories(starts: DataFrame, seconds: float = 3.0, dt: float = 0.01, l1: float = 1.0, l2: float = 1.0, m1: float = 1.0, m2: float = 1.0) -> DataFrame:
    """``traj_id, step, t, theta1, z1, theta2, z2`` from ``traj_id, theta1, z1, theta2, z2``, by fourth-order Runge-Kutta steps."""
    steps = round(seconds / dt)

    def run(frames):  # noqa: ANN001, ANN202
        for frame in frames:
            for traj, *state in frame[["traj_id", "theta1", "z1", "theta2", "z2"]].itertuples(index=False, name=None):
                y, rows = np.array(state, dtype=float), []
                for k in range(steps + 1):
                    rows.append((traj, k, k * dt, *y))
                    k1 = _accelerations(y, l1, l2, m1, m2)
                    k2 = _accelerations(y + dt / 2 * k1, l1, l2, m1, m2)
                    k3 = _accelerations(y + dt / 2 * k2, l1, l2, m1, m2)
                    k4 = _accelerations(y + dt * k3, l1, l2, m1, m2)
                    y = y + dt / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
                yield pd.DataFrame(rows, columns=["traj_id", "step", "t", "theta1", "z1", "theta2", "z2"])

    return starts.mapInPandas(run, "traj_id long, step int, t double, theta1 double, z1 double, theta2 double, z2 double")


def positions(states: DataFrame, l1: float = 1.0, l2: float = 1.0) -> DataFrame:
    """Adds the Cartesian places of both bobs."""
    first = {"x1": l1 * F.sin("theta1"), "y1": -l1 * F.cos("theta1")}
    return states.withColumns(first).withColumns({"x2": F.col("x1") + l2 * F.sin("theta2"), "y2": F.col("y1") - l2 * F.cos("theta2")})


def energy(states: DataFrame, l1: float = 1.0, l2: float = 1.0, m1: float = 1.0, m2: float = 1.0) -> DataFrame:
    v1, v2 = l1 * F.col("z1"), l2 * F.col("z2")
    potential = -(m1 + m2) * l1 * G * F.cos("theta1") - m2 * l2 * G * F.cos("theta2")
    kinetic = 0.5 * m1 * v1 * v1 + 0.5 * m2 * (v1 * v1 + v2 * v2 + 2 * v1 * v2 * F.cos(F.col("theta1") - F.col("theta2")))
    return states.withColumn("energy", potential + kinetic)


def energy_drift(states: DataFrame) -> DataFrame:
    """``traj_id, drift``: summed distance from the energy at the start."""
    rows = energy(states)
    start = rows.filter("step = 0").select("traj_id", F.col("energy").alias("e0"))
    return rows.join(start, "traj_id").groupBy("traj_id").agg(F.sum(F.abs(F.col("energy") - F.col("e0"))).alias("drift"))


def trails(states: DataFrame, length: int = 100, segments: int = 20) -> DataFrame:
    """``traj_id, step, segment, alpha``: the trailing steps in segments that fade out."""
    order = Window.partitionBy("traj_id").orderBy("step").rowsBetween(-length, 0)
    rows = states.withColumn("__n", F.count("*").over(order)).select("traj_id", "step", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"), "__n")
    return rows.filter(F.col("__n") > length - (F.col("segment") + 1) * (length // segments)).select("traj_id", "step", "segment", F.pow(F.col("segment") / F.lit(float(segments)), F.lit(2.0)).alias("alpha"))


def frames(states: DataFrame, fps: int = 10, dt: float = 0.01) -> DataFrame:
    every = int(1 / fps / dt)
    return states.filter(F.col("step") % every == 0)
