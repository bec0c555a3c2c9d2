"""The secret of pseudonyms: made once, kept in a file that only its owner reads, given to plans as a one-row table."""

from __future__ import annotations

import os
import secrets
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BYTES = 32


def default_path() -> Path:
    """Where the secret is kept unless a path is given: the user's folder for application data."""
    base = os.environ.get("APPDATA") or os.environ.get("XDG_DATA_HOME") or Path.home() / ".local" / "share"
    return Path(base) / "palimpsest" / "secret"


def load_secret(path: str | Path | None = None) -> str:
    """The secret in hexadecimal; on first use it is drawn and written with mode 0600. A file of another length is refused.

    Two drivers that start together get the same one: the file appears whole, by a link that only the first can make.
    """
    at = Path(path) if path else default_path()
    if not at.exists():
        at.parent.mkdir(parents=True, exist_ok=True)
        fresh = at.with_name(f"{at.name}.{secrets.token_hex(8)}")
        handle = os.open(fresh, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        with os.fdopen(handle, "wb") as f:
            f.write(secrets.token_bytes(BYTES))
        try:
            os.link(fresh, at)
        except FileExistsError:
            pass
        finally:
            fresh.unlink()
    content = at.read_bytes()
    if len(content) != BYTES:
        raise ValueError(f"{at} holds no secret of {BYTES} bytes")
    return content.hex()


def secret_table(spark: SparkSession, path: str | Path | None = None) -> DataFrame:
    """(secret_hex) in one row, to be cross joined by broadcast: so the secret is data and no literal of a plan or an event log."""
    return spark.createDataFrame([(load_secret(path),)], "secret_hex string")
