"""Files from elsewhere: downloads that are whole or absent, pinned digests, a ledger of failures, and registries."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession

BLOCK = 1 << 20


@dataclass(frozen=True)
class Wanted:
    """A file to fetch: where from, its name in the target folder, and the digests it must have (by algorithm)."""

    name: str
    url: str
    file: str
    digests: tuple[tuple[str, str], ...] = ()


def file_digest(path: Path, algorithm: str = "sha256") -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, algorithm).hexdigest()


def check_digests(path: Path, wanted: Wanted) -> None:
    for algorithm, digest in wanted.digests:
        if file_digest(path, algorithm) != digest.lower():
            raise ValueError(f"{wanted.name}: {algorithm} of {path.name} differs")


def fetch(wanted: Wanted, folder: str, timeout: float = 180) -> dict:
    """Its manifest entry. A file that is there already is only checked; a new one gets its name once it is whole and has
    the right digests, until then it is `.part` (and stays for inspection if it fails)."""
    target = Path(folder) / wanted.file
    target.parent.mkdir(parents=True, exist_ok=True)
    if not target.exists() or not target.stat().st_size:
        part = target.with_name(target.name + ".part")
        with urlopen(wanted.url, timeout=timeout) as source, part.open("wb") as out:
            while block := source.read(BLOCK):
                out.write(block)
        if not part.stat().st_size:
            raise ValueError(f"{wanted.name}: nothing came from {wanted.url}")
        check_digests(part, wanted)
        part.replace(target)
    check_digests(target, wanted)
    return {"dataset": wanted.name, "source_url": wanted.url, "relative_path": wanted.file, "bytes": target.stat().st_size, "sha256": file_digest(target)}


def fetch_all(wanted: Iterable[Wanted], folder: str, ledger: str, workers: int = 4) -> dict[str, dict]:
    """Manifest entries by name, each written beside its file. What fails is written to the ledger folder, the others go
    on, and at the end the failures are raised together."""
    wanted, done, failed = list(wanted), {}, {}
    with ThreadPoolExecutor(workers) as pool:
        running = {w: pool.submit(fetch, w, folder) for w in wanted}
    for w, job in running.items():
        if (error := job.exception()) is None:
            done[w.name] = job.result()
            (Path(folder) / f"{w.file}.manifest.json").write_text(json.dumps(done[w.name], indent=2, sort_keys=True) + "\n")
        else:
            failed[w.name] = error
            Path(ledger).mkdir(parents=True, exist_ok=True)
            (Path(ledger) / f"{w.name}_failure.json").write_text(json.dumps({"acquired": False, "dataset": w.name, "reason": str(error)}, indent=2) + "\n")
    if failed:
        raise ValueError(f"not acquired: {sorted(failed)}")
    return done


def verify_manifest(folder: str, entries: Mapping[str, str], pinned: Mapping[str, str]) -> None:
    """Raise unless a cached manifest (file to SHA-256) names just the pinned files and both it and the files have the pinned digests."""
    if set(entries) != set(pinned):
        raise ValueError(f"incomplete: {sorted(set(entries) ^ set(pinned))}")
    for file, digest in pinned.items():
        if not entries[file] == digest == file_digest(Path(folder) / file):
            raise ValueError(f"{file}: digest differs")


def parse_registry(text: str) -> dict[str, dict[str, str]]:
    """Entries of a two-level YAML mapping under one heading (names, then key: value); comments and blank lines are skipped."""
    found: dict[str, dict[str, str]] = {}
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        depth, (key, _, value) = len(body) - len(body.lstrip()), body.strip().partition(":")
        if depth == 0:
            continue
        if not value.strip():
            found[key] = own = {}
        elif found:
            own[key] = value.strip().strip("\"'")
    return found


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """name, key, value of every entry of a registry file, in any store that Spark reads."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame([(n, k, v) for n, own in parse_registry(text).items() for k, v in own.items()], "name string, key string, value string")
