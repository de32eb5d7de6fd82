"""Junction figures kept up to date as tickets arrive.

What a batch of tickets adds is folded to long sums per junction, station, vehicle
type and hour and written under the batch's id. Sums of batches add up in any
order, so every report of AGG-1 to AGG-7 comes from the folded rows alone and no
ticket is read twice. A batch that arrives again replaces what it wrote, or changes
nothing once it has been merged, so replays after a failure do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline import constants as C
from kerbline.operators import junctions
from kerbline.session import _delete, children

DONE = "_SUCCESS"  # Spark's mark of a folder whose write has ended


@dataclass(frozen=True)
class JunctionState:
    """Folded batches in ``folder``, which all executors share.

    ``batches/<id>`` holds one batch. ``merged/<number>`` holds all batches of the
    id ranges in its ``ids``; the highest finished number counts. One writer at a
    time applies and merges; readers may run beside it.
    """

    spark: SparkSession
    folder: str

    def apply(self, batch_id: int, tickets: DataFrame) -> bool:
        """Add a batch of scored tickets; False if it has already been merged.

        An id stands for its rows: applied again, a batch replaces itself.
        """
        _, ranges = self._merged()
        if _covered(ranges, batch_id):
            return False
        junctions.fold_junctions(tickets).write.mode("overwrite").parquet(f"{self.folder}/batches/{batch_id}")
        return True

    def folded(self) -> DataFrame | None:
        """All batches as one folded table; None before the first."""
        number, ranges = self._merged()
        paths = [f"{self.folder}/batches/{i}" for i in self._pending(ranges)]
        if number is not None:
            paths.append(f"{self.folder}/merged/{number}/rows")
        return junctions.merge_folds(self.spark.read.parquet(*paths)) if paths else None

    def merge(self) -> None:
        """Fold the waiting batches into the merged rows, so that reading them stays as cheap as their keys are few."""
        number, ranges = self._merged()
        waiting = self._pending(ranges)
        if not waiting:
            return
        target = f"{self.folder}/merged/{0 if number is None else number + 1}"
        self.folded().write.mode("overwrite").parquet(f"{target}/rows")
        joined = _joined([*ranges, *((i, i) for i in waiting)])
        # Written last: without it the merge does not count.
        self.spark.createDataFrame(joined, "first long, last long").coalesce(1).write.mode("overwrite").parquet(f"{target}/ids")
        for i in waiting:
            _delete(self.spark, f"{self.folder}/batches/{i}")
        for old in children(self.spark, f"{self.folder}/merged"):
            if number is not None and int(old) < number:  # the last one may still be read
                _delete(self.spark, f"{self.folder}/merged/{old}")

    def summary(self, days: int = C.REPORT_DAYS) -> DataFrame:
        return junctions.summary_of(self.folded(), days)

    def vehicle_mix(self) -> DataFrame:
        return junctions.mix_of(self.folded().groupBy("junction_name", "vehicle_type").agg(F.sum("n").alias("n")))

    def peak_hours(self) -> DataFrame:
        return junctions.peaks_of(self.folded().where("hour IS NOT NULL").groupBy("junction_name", "hour").agg(F.sum("n").alias("n")))

    def hourly_trend(self) -> DataFrame:
        return junctions.trends_of(junctions.hourly_of(self.folded()))

    def trend_multipliers(self) -> DataFrame:
        return junctions.multipliers_of(junctions.hourly_of(self.folded()))

    def records(self, days: int = C.REPORT_DAYS) -> DataFrame:
        return junctions.records_of(self.folded(), days)

    def metadata(self, days: int = C.REPORT_DAYS) -> DataFrame:
        return junctions.metadata_of(self.folded(), days)

    def _merged(self) -> tuple[int | None, list[tuple[int, int]]]:
        """The merged rows that count, and the id ranges in them."""
        root = f"{self.folder}/merged"
        for number in sorted(map(int, children(self.spark, root)), reverse=True):
            if DONE in children(self.spark, f"{root}/{number}/ids"):
                return number, [(r["first"], r["last"]) for r in self.spark.read.parquet(f"{root}/{number}/ids").collect()]
        return None, []

    def _pending(self, ranges: list[tuple[int, int]]) -> list[int]:
        """Finished batches that are not merged."""
        root = f"{self.folder}/batches"
        found = sorted(map(int, children(self.spark, root)))
        return [i for i in found if not _covered(ranges, i) and DONE in children(self.spark, f"{root}/{i}")]


def _covered(ranges: list[tuple[int, int]], i: int) -> bool:
    return any(first <= i <= last for first, last in ranges)


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same ids in as few ranges as possible; consecutive ids, as a stream numbers its batches, are one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out
