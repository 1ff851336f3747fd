"""Settings from the environment, typed by the class's annotations."""

from __future__ import annotations

import os
from dataclasses import MISSING, dataclass, fields

_YES = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Settings:
    """Names, kinds and defaults are an interface (fixed values); those without a default are required."""

    STORAGE_PATH: str
    RNS_CONFIGDIR: str
    NODE_IDENTITY_PATH: str
    TEMPLATES_DIR: str
    LOG_LEVEL: str
    TIME_FORMAT: str = "%d.%m.%Y, %H:%M:%S"
    ANNOUNCE_NAME: str = "moorgrid"
    CRAWLER_THREADS: int = 5
    CRAWLER_QUEUE_MAXSIZE: int = 5000
    CRAWLER_VISITED_CACHE_SECONDS: int = 86400
    NODE_REMOVE_AFTER_DAYS: int = 14
    NOMAD_NODE_ANNOUNCE_LOG_KEEP_DAYS: int = 14
    LOG_PATH: str = "logs"

    def announce_log(self) -> str:
        """The folder of the announce log."""
        return f"{self.LOG_PATH}/announces"


def from_env(cls=Settings, env: dict | None = None):
    """An instance of cls; every missing required name is listed in one error."""
    env = os.environ if env is None else env
    values, missing = {}, []
    for f in fields(cls):
        if f.name in env:
            kind = f.type if isinstance(f.type, type) else {"int": int, "float": float, "str": str, "bool": bool}[f.type]
            values[f.name] = env[f.name].strip().lower() in _YES if kind is bool else kind(env[f.name])
        elif f.default is MISSING and f.default_factory is MISSING:
            missing.append(f.name)
    if missing:
        raise ValueError("missing settings: " + ", ".join(missing))
    return cls(**values)
