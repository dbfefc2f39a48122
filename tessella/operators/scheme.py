"""Parameters of a tiling."""

from __future__ import annotations

from dataclasses import dataclass, replace

ALIGNMENTS = ("optimized", "centered_to_image", "aligned_to_image_border")


@dataclass(frozen=True)
class MercatorScheme:
    """Slippy-map tiles of one zoom."""

    zoom: int
    keep_borders: bool = False


@dataclass(frozen=True)
class LocalScheme:
    """Tiles of a raster's own pixel grid; size and stride (width, height) in unit pixel or meter."""

    size: tuple[float, float]
    stride: tuple[float, float] | None = None
    unit: str = "pixel"
    alignment: str = "centered_to_image"
    overhang: bool = True
    align_to_base: bool = False
    keep_borders: bool = True

    def __post_init__(self):
        if self.alignment not in ALIGNMENTS:
            raise ValueError(f"alignment must be one of {ALIGNMENTS}")
        if self.unit not in ("pixel", "meter"):
            raise ValueError("unit must be pixel or meter")
        if min(*self.size, *(self.stride or self.size)) <= 0:
            raise ValueError("sizes and strides must be positive")
        if self.stride is None:
            object.__setattr__(self, "stride", self.size)

    def with_stride(self, stride: tuple[float, float]) -> LocalScheme:
        return replace(self, stride=stride)

    def check_fusable(self) -> None:
        """Fusion needs base tiles at a fixed place and aux tiles up to the border."""
        if self.alignment == "optimized":
            raise ValueError("fusion needs an alignment other than optimized")
        if not self.overhang:
            raise ValueError("fusion needs overhanging tiles")
