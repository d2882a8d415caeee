"""Small artifacts on the driver: canonical JSON, envelopes chained by digests, manifests, atomic publishing.

Tables go to Parquet; what is written here is bounded: a manifest, a report, a list of stages.
"""

from __future__ import annotations

import hashlib
import json
import os
import platform
import re
import uuid
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stages and the stages that each is made from.
STAGE_INPUTS = {"discovery": (), "body": ("discovery",), "universe": ("discovery", "body"), "relation": ("universe",)}
SCHEMA_VERSION = 3
_BUILD = re.compile(r"^(?P<case>.+)\.(?P<build>O\d+[A-Z]*)$")


def canonical_bytes(value: Any) -> bytes:
    """Compact JSON with sorted keys."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()


def digest(value: Any) -> str:
    return hashlib.sha256(canonical_bytes(value)).hexdigest()


def pretty_bytes(value: Any) -> bytes:
    return (json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2, allow_nan=False) + "\n").encode()


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order: the sum of row digests and their number."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    total = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0)).alias("s")).first()
    return hashlib.sha256(f"{total['n']}:{total['s']}:{','.join(sorted(df.columns))}".encode()).hexdigest()


def envelope(stage: str, subject_sha256: str, inputs: Mapping[str, str], payload: Any) -> dict[str, Any]:
    """A stage's payload with the digests of what it was made from; no path or tool is named."""
    if set(inputs) != set(STAGE_INPUTS[stage]):
        raise ValueError(f"stage {stage} is made from {', '.join(STAGE_INPUTS[stage]) or 'nothing'}")
    return {"schema_version": SCHEMA_VERSION, "artifact": "kinweave-stage", "stage": stage, "subject": {"sha256": subject_sha256}, "inputs": dict(inputs), "payload": payload}


def publish(files: Mapping[str, bytes]) -> None:
    """Writes all files or none: staged beside their places, then moved there; what stood there comes back if a move fails."""
    places = {os.path.realpath(p) for p in files}
    if len(places) < len(files):
        raise ValueError("two files of one place")
    mark = uuid.uuid4().hex
    staged, moved = {}, []
    try:
        for p, content in files.items():
            Path(p).parent.mkdir(parents=True, exist_ok=True)
            staged[p] = f"{p}.{mark}.new"
            Path(staged[p]).write_bytes(content)
        for p, new in staged.items():
            if os.path.isdir(p):
                raise IsADirectoryError(p)
            old = f"{p}.{mark}.old" if os.path.exists(p) else None
            if old:
                os.replace(p, old)
            moved.append((p, old))
            os.replace(new, p)
    except BaseException:
        for p, old in reversed(moved):
            if old and os.path.exists(old):
                os.replace(old, p)
            elif not old and os.path.exists(p):
                os.remove(p)
        raise
    finally:
        for new in staged.values():
            if os.path.exists(new):
                os.remove(new)
    for _, old in moved:
        if old and os.path.exists(old):
            os.remove(old)


def write_json(path: str, value: Any) -> str:
    """Writes canonical, readable JSON and returns its digest."""
    content = pretty_bytes(value)
    publish({path: content})
    return hashlib.sha256(content).hexdigest()


def read_json(path: str, declared: str | None = None) -> tuple[Any, str]:
    """(value, digest of the bytes); an error if a declared digest differs."""
    raw = Path(path).read_bytes()
    found = hashlib.sha256(raw).hexdigest()
    if declared is not None and declared != found:
        raise ValueError(f"{path}: digest {found} is not the declared {declared}")
    return json.loads(raw), found


def load_stages(paths: Mapping[str, str]) -> tuple[dict[str, dict], dict[str, str]]:
    """Stages by name with their digests; an error if kinds, subjects or the chain of inputs don't agree."""
    stages, digests = {}, {}
    for name, path in paths.items():
        stages[name], digests[name] = read_json(path)
    subjects = {s["subject"]["sha256"] for s in stages.values()}
    if len(subjects) > 1:
        raise ValueError("stages of several subjects")
    for name, s in stages.items():
        if s["stage"] != name:
            raise ValueError(f"{paths[name]} holds stage {s['stage']}")
        for other, sha in s["inputs"].items():
            if other in digests and digests[other] != sha:
                raise ValueError(f"stage {name} was made from another {other}")
    return stages, digests


def digest_files(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of files that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def json_stage(spark: SparkSession, path: str, payload_schema: str) -> DataFrame:
    """The payload of stage files as columns, with the digest of the file it came from."""
    raw = spark.read.format("binaryFile").load(path)
    parsed = F.from_json(F.decode("content", "UTF-8"), f"stage string, payload struct<{payload_schema}>", {"mode": "FAILFAST"})
    return raw.select("path", F.sha2("content", 256).alias("sha256"), parsed.alias("s")).select("path", "sha256", "s.stage", "s.payload.*")


def write_table(df: DataFrame, path: str) -> str:
    """Parquet at a path where nothing is yet; returns the table's digest."""
    df.write.mode("errorifexists").parquet(path)
    return table_digest(df.sparkSession.read.parquet(path))


def fingerprint(spark: SparkSession) -> dict[str, str]:
    """What ran: for the run's manifest, never for an artifact."""
    return {"spark": spark.version, "python": platform.python_version(), "platform": platform.platform(), "machine": platform.machine()}


def split_case_build(name: str) -> tuple[str, str | None]:
    """('case', 'O2') of 'case.O2'."""
    found = _BUILD.match(name)
    return (found["case"], found["build"]) if found else (name, None)


def artifact_path(root: str, kind: str, case: str, build: str, profile: str = "", suffix: str = "parquet") -> str:
    """One place for each kind, case, build and profile."""
    for part in (kind, case, build, profile):
        if "/" in part or part in (".", ".."):
            raise ValueError(f"not a name: {part}")
    return "/".join([root.rstrip("/"), f"kind={kind}", f"case={case}", f"build={build}", *([f"profile={profile}"] if profile else []), f"data.{suffix}"])
