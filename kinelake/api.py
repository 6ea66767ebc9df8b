"""A session over a table of results: list, filter, sort, page, edit, undo, export."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.operators import edits, results
from kinelake.operators.edits import MOST_ROWS, MOST_UNDO
from kinelake.operators.gates import PRESETS

#: Sort orders by name; unknown values come last, ties go by id.
ORDERS = {
    "best": lambda: [F.desc_nulls_last("score")], "worst": lambda: [F.asc_nulls_last("score")], "time": lambda: [F.asc_nulls_last("start")], "time_desc": lambda: [F.desc_nulls_last("start")],
    "longest": lambda: [F.desc_nulls_last(F.col("end") - F.col("start"))], "shortest": lambda: [F.asc_nulls_last(F.col("end") - F.col("start"))], "source": lambda: [F.asc_nulls_last("source"), F.asc_nulls_last("start")],
    "class": lambda: [F.asc_nulls_last("class"), F.desc_nulls_last("score")], "yaw": lambda: [F.asc_nulls_last("yaw"), F.desc_nulls_last("score")],
}
REVIEWS = ("favorite", "hidden", "unreviewed")
FORMATS = {"csv", "json", "parquet"}


def checked(given: dict, schema: dict[str, tuple]) -> dict:
    """Arguments that a schema {name: (type, test)} allows; unknown names, other types and values that fail the test raise ValueError."""
    for k, v in given.items():
        if k not in schema:
            raise ValueError(f"unknown argument {k}")
        kind, ok = schema[k]
        if v is not None and (isinstance(v, bool) != (kind is bool) or not isinstance(v, kind) or not ok(v)):
            raise ValueError(f"bad value for {k}")
    return given


@dataclass
class Session:
    """rows: (id, source, start, end, score, class, yaw). Edits are a log on top of them; nothing is rewritten until export()."""

    rows: DataFrame
    log: list[tuple[int, int, str, str]] = field(default_factory=list)
    undoable: int = 0

    def _edit(self, result: int, action: str, value: str) -> None:
        if len(self.log) >= MOST_ROWS:
            raise ValueError("the edit log is full: export and start anew")
        self.log.append((len(self.log), result, action, value))
        self.undoable = min(MOST_UNDO, self.undoable + 1)

    def set_classification(self, result: int, name: str) -> None:
        checked({"name": name}, {"name": (str, lambda v: 0 < len(v) <= 64)})
        self._edit(result, "class", name)

    def set_review(self, result: int, review: str) -> None:
        checked({"review": review}, {"review": (str, lambda v: v in REVIEWS)})
        self._edit(result, "review", review)

    def set_clip_range(self, result: int, start: float, end: float) -> None:
        checked({"start": float(start), "end": float(end)}, {"start": (float, lambda v: v >= 0), "end": (float, lambda v: v > start)})
        self._edit(result, "range", f"{float(start)}:{float(end)}")

    def reset_clip_range(self, result: int) -> None:
        """An edit as others, so it can be taken back."""
        self._edit(result, "range", "")

    def undo(self) -> bool:
        """Takes back the last edit; of a row of edits the last MOST_UNDO can be taken back."""
        if not self.undoable:
            return False
        self.log.pop()
        self.undoable -= 1
        return True

    def current(self) -> DataFrame:
        spark = self.rows.sparkSession
        log = spark.createDataFrame(self.log, "seq long, id long, action string, value string")
        x = edits.overlaid(self.rows, edits.in_force(log), ["class", "review", "range"])
        at = lambda i: F.try_element_at(F.split(F.nullif("edit_range", F.lit("")), ":"), F.lit(i + 1)).cast("double")
        return (
            x.withColumn("class", F.coalesce("edit_class", "class")).withColumn("review", F.coalesce("edit_review", F.lit("unreviewed")))
            .withColumn("start", F.coalesce(at(0), "start")).withColumn("end", F.coalesce(at(1), "end")).drop("edit_class", "edit_review", "edit_range")
        )

    def list_results(self, offset: int = 0, limit: int = 50, order: str = "best", **conditions) -> dict:
        """A page with the total and the next offset (None at the end)."""
        checked({"offset": offset, "limit": limit, "order": order}, {"offset": (int, lambda v: v >= 0), "limit": (int, lambda v: 1 <= v <= 200), "order": (str, lambda v: v in ORDERS)})
        x = results.filtered(self.current(), **conditions)
        total = x.count()
        rows = [r.asDict() for r in results.page(x, [*ORDERS[order](), F.asc("id")], offset, limit).collect()]
        return {"total": total, "rows": rows, "next": offset + limit if offset + limit < total else None}

    def list_classes(self) -> dict[str, int]:
        from kinelake.operators.evidence import class_counts

        return {r["class"]: r["n"] for r in class_counts(self.current(), "class").collect()}

    def status(self) -> dict:
        return {"results": self.rows.count(), "edits": len(self.log), "presets": sorted(PRESETS)}

    def export(self, path: str, fmt: str = "parquet", order: str = "best", by_class: list[str] = ()) -> None:
        """Writes what is not hidden, in order; classes that are named come first, in that order."""
        checked({"fmt": fmt, "order": order}, {"fmt": (str, lambda v: v in FORMATS), "order": (str, lambda v: v in ORDERS)})
        x = self.current().where("review <> 'hidden'")
        rank = F.array_position(F.array(*[F.lit(c) for c in by_class]), F.col("class")) if by_class else F.lit(0)
        x = x.orderBy(F.when(rank == 0, len(by_class) + 1).otherwise(rank), *ORDERS[order](), F.asc("id"))
        x.write.mode("overwrite").options(**({"header": True, "quote": '"', "escape": '"'} if fmt == "csv" else {})).format(fmt).save(path)

    def run(self, tag: str, work):
        """work(self) under a tag, so that another thread can end its jobs with interrupt(tag)."""
        spark = self.rows.sparkSession
        spark.addTag(tag)
        try:
            return work(self)
        finally:
            spark.removeTag(tag)

    def interrupt(self, tag: str) -> list[str]:
        """Ends the jobs that run under a tag."""
        return self.rows.sparkSession.interruptTag(tag)
