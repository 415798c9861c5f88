"""Run parameters with the published default values."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Imagery:
    """How patches lie on the Web-Mercator pixel grid."""

    zoom: int = 19
    tile_size: int = 256
    patch_size: int = 1024
    grid_size: int = 5

    @property
    def world_size(self) -> int:
        return self.tile_size * 2**self.zoom


@dataclass(frozen=True)
class Detection:
    """Thresholds applied to detector boxes."""

    confidence: float = 0.05
    nms_iou: float = 0.5
    min_distance_m: float = 150.0
    dedup_distance_m: float = 30.0
