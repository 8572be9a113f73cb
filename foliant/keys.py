"""The signing key of a folder, and the switch that turns verification off."""

from __future__ import annotations

import os
import re
import secrets
from pathlib import Path

KEY_FILE = "archive.key"
OFF = {"0", "false", "off", "no"}


def read_key(path: Path) -> bytes | None:
    """32 bytes from 64 hex digits; None for anything else."""
    text = path.read_text().strip()
    return bytes.fromhex(text) if re.fullmatch(r"[0-9a-f]{64}", text) else None


def load_or_create(folder: str | Path) -> bytes | None:
    """The folder's key, made when there is none. A malformed key is not replaced: None, so nothing is trusted."""
    path = Path(folder) / KEY_FILE
    try:
        Path(folder).mkdir(parents=True, exist_ok=True)
        handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    except FileExistsError:
        return read_key(path)  # also when another process was first
    except OSError:
        return None
    key = secrets.token_bytes(32)
    with os.fdopen(handle, "w") as out:
        out.write(key.hex())
    return key


def verification_off(environment: dict[str, str], name: str = "FOLIANT_VERIFY") -> bool:
    return environment.get(name, "").strip().lower() in OFF
