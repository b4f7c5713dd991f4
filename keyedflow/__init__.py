"""keyedflow: keyed JSON streams and tables as PySpark DataFrame functions.

Records are rows of an *envelope* DataFrame with the columns

    key STRING, value STRUCT or VARIANT, ts TIMESTAMP (ms), partition INT, offset BIGINT

``(partition, offset)`` is the arrival order of a record within its source.
"""

from keyedflow.functions.exprs import (
    as_bool,
    as_double,
    as_node,
    as_text,
    lenient_text,
    now_millis,
    path,
    template,
)
from keyedflow.operators.aggregates import (
    Count,
    Sum,
    drop_late,
    window_aggregate,
    window_aggregate_changelog,
)
from keyedflow.operators.enrich import enrich_as_of, enrich_lookup
from keyedflow.operators.joins import (
    interval_join,
    latest_by_key,
    table_join_changelog,
    table_join_latest,
)
from keyedflow.operators.transforms import colocate, filter_, key_partition, mapping, merge, rekey
from keyedflow.sinks.cache import cache_list, cache_set
from keyedflow.sinks.topics import encode, write_topic
from keyedflow.sources.envelope import decode, stream_of
from keyedflow.sources.topics import read_topic, read_topic_files

__all__ = [
    "Count",
    "Sum",
    "as_bool",
    "as_double",
    "as_node",
    "as_text",
    "cache_list",
    "cache_set",
    "colocate",
    "decode",
    "drop_late",
    "encode",
    "enrich_as_of",
    "enrich_lookup",
    "filter_",
    "interval_join",
    "key_partition",
    "latest_by_key",
    "lenient_text",
    "mapping",
    "merge",
    "now_millis",
    "path",
    "read_topic",
    "read_topic_files",
    "rekey",
    "stream_of",
    "table_join_changelog",
    "table_join_latest",
    "template",
    "window_aggregate",
    "window_aggregate_changelog",
    "write_topic",
]
