"""telemark: telemetry analytics, result comparison and corpus processing on Spark.

Every public function is either ``Column -> Column`` or ``DataFrame -> DataFrame``;
nothing here collects rows to the driver except schema-sized metadata.
"""

from telemark.session import get_session, ship_package

__all__ = ["get_session", "ship_package"]
