"""Stopping a conversion from another thread."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import SparkSession


class Cancelled(Exception):
    """The conversion was asked to stop."""


class Cancellation:
    """A flag that any thread may set; setting it also stops the conversion's running jobs."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.group, self._asked = spark, f"docmill-{uuid.uuid4().hex}", threading.Event()

    @property
    def asked(self) -> bool:
        return self._asked.is_set()

    def cancel(self) -> None:
        self._asked.set()
        self.spark.sparkContext.cancelJobGroup(self.group)

    def enter(self) -> None:
        """Jobs that this thread starts from here on are the conversion's."""
        self.spark.sparkContext.setJobGroup(self.group, "docmill conversion", interruptOnCancel=True)

    def check(self) -> None:
        if self.asked:
            raise Cancelled("the conversion was cancelled")
