"""Settings of the crawler and of the extractor."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from kartei.operators.eligibility import Filters


@dataclass(frozen=True)
class Settings:
    """What is indexed and how much of it is extracted."""

    recursive_directories: tuple[str, ...] = ("&DOCUMENTS", "&MUSIC", "&PICTURES", "&VIDEOS")
    single_directories: tuple[str, ...] = ("$HOME",)
    ignored_files: tuple[str, ...] = Filters.file
    ignored_directories: tuple[str, ...] = Filters.directory
    ignored_directories_with_content: tuple[str, ...] = Filters.parent_directory
    text_allowlist: tuple[str, ...] = Filters.text_allowed
    enable_monitors: bool = True
    index_removable_devices: bool = False
    max_bytes: int = 1 << 20

    def __post_init__(self) -> None:
        if not 0 <= self.max_bytes <= 10 << 20:
            raise ValueError("max_bytes lies between 0 and 10 MiB")

    @property
    def filters(self) -> Filters:
        return Filters(self.ignored_files, self.ignored_directories, self.ignored_directories_with_content, self.text_allowlist)

    @classmethod
    def load(cls, text: str) -> Settings:
        """From JSON; unknown names are an error."""
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()})

    def dump(self) -> str:
        return json.dumps(asdict(self), indent=1)
