"""What a caller may lay down against the heuristics."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import constants as C


class _Unset:
    def __repr__(self) -> str:
        return "UNSET"


#: Not given, as against None, which declares that there is no header.
UNSET = _Unset()


@dataclass
class BlockOverride:
    """For the band that holds row ``anchor_row``."""

    anchor_row: int
    header_row: int | None | _Unset = UNSET
    skip_rows_add: list[int] = field(default_factory=list)


@dataclass
class SheetOverride:
    sheet: str
    header_row: int | None | _Unset = UNSET
    is_tabular: bool | None = None
    skip_rows_add: list[int] = field(default_factory=list)
    skip_rows_remove: list[int] = field(default_factory=list)
    dtype_force: dict[str, str] = field(default_factory=dict)
    blocks: list[BlockOverride] = field(default_factory=list)


@dataclass
class InspectionOptions:
    sheets: list[SheetOverride] = field(default_factory=list)
    header_threshold: float = C.HEADER_THRESHOLD
    skip_keywords: tuple[str, ...] = C.SKIP_KEYWORDS
    na_values: tuple[str, ...] = C.NA_TEXTS

    def of(self, sheet: str) -> SheetOverride:
        return next((s for s in self.sheets if s.sheet == sheet), SheetOverride(sheet))
