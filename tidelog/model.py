"""Data model: schemas, statuses and options of the key-value engine."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import types as T

#: Outcomes of a query, with their codes.
STATUS = {"NOT_FOUND": 0, "FOUND": 1, "DELETED": 2, "BUFFER_TOO_SMALL": 3, "NOT_IN_CACHE": 4}

SEQUENTIAL, RELAXED = "SEQUENTIAL", "RELAXED"
READONLY, READANDWRITE = "READONLY", "READANDWRITE"

#: The operation log: a delete is a record of its own (op DEL), never a null or empty value.
OPLOG = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("epoch", T.LongType(), False),
        T.StructField("writer", T.IntegerType(), False),
        T.StructField("owner", T.IntegerType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

#: One timed operation, as the measurement files have it.
OPTIME = T.StructType([T.StructField("optime", T.DoubleType()), T.StructField("owner", T.DoubleType())])

#: Environment variable of each option that can be read from the environment.
ENVIRONMENT = {
    "max_local_memtable_size": "MAX_LOCAL_MEMTABLE_SIZE",
    "max_remote_memtable_size": "MAX_REMOTE_MEMTABLE_SIZE",
    "max_local_cache_size": "MAX_LOCAL_CACHE_SIZE",
    "max_remote_cache_size": "MAX_REMOTE_CACHE_SIZE",
    "cache_avg_key_size": "CACHE_AVG_KEY_SIZE",
    "dispatch_batch_size": "DISPATCH_BATCH_SIZE",
    "dispatch_in_chunks": "DISPATCH_IN_CHUNKS",
    "storage_location": "STORAGE_LOCATION",
}


@dataclass(frozen=True)
class KVOptions:
    """Options of a store; setters return a changed copy."""

    max_local_memtable_size: int = 1_000_000
    max_remote_memtable_size: int = 1_000_000
    max_local_cache_size: int = 1_000_000
    max_remote_cache_size: int = 1_000_000
    cache_avg_key_size: int = 32
    dispatch_batch_size: int = 1000
    dispatch_in_chunks: bool = True
    consistency: str = RELAXED
    mode: str = READANDWRITE
    strict: bool = False
    storage_location: str = ""

    def with_(self, **changes) -> KVOptions:
        """A copy with the options named changed."""
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise TypeError(f"no such option: {', '.join(sorted(unknown))}")
        return replace(self, **changes)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> KVOptions:
        """Defaults, changed by the variables of the environment that are set."""
        env = os.environ if env is None else env
        out = {}
        for name, variable in ENVIRONMENT.items():
            if variable in env:
                raw = env[variable]
                out[name] = raw if name == "storage_location" else bool(int(raw)) if name == "dispatch_in_chunks" else int(raw)
        return cls(**out)
