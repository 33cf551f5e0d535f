"""Settings of the reconstruction, read from `key: value` lines."""

from __future__ import annotations

from dataclasses import dataclass, fields

#: fixed values: keys that a settings file must have, as its format defines
REQUIRED = (
    "input_img_dir", "camera_extrinsic_path", "camera_intrinsic_path", "camera_timestamp_path", "projective_z_buffer_dir",
    "output_path", "lidar_ply_dirs", "lidar_kf_path", "sift_nfeatures", "sift_n_octave_layers", "sift_contrast_threshold",
    "sift_edge_threshold", "sift_sigma", "ratio_threshold", "ransac_threshold", "min_inliers", "num_iteration",
)


@dataclass(frozen=True)
class Config:
    input_img_dir: str = ""
    camera_extrinsic_path: str = ""
    camera_intrinsic_path: str = ""
    camera_timestamp_path: str = ""
    projective_z_buffer_dir: str = ""
    output_path: str = ""
    lidar_ply_dirs: str = ""
    lidar_kf_path: str = ""
    landmark_cache_path: str = "../data/landmarks_cache.bin"
    sift_nfeatures: int = 0
    sift_n_octave_layers: int = 3
    sift_contrast_threshold: float = 0.04
    sift_edge_threshold: float = 10.0
    sift_sigma: float = 1.6
    ratio_threshold: float = 0.75
    ransac_threshold: float = 1.0
    min_inliers: int = 8
    sift_max_match_distance: float = -1.0
    sequential_match_window_size: int = 5
    num_iteration: int = 20
    max_images: int = -1
    ceres_max_iterations: int = 50
    ba_cost_threshold: float = 1e-4  # used only where early stopping is asked for
    landmark_reprojection_error_threshold: float = 4.0

    @classmethod
    def parse(cls, text: str) -> Config:
        """Settings of a flat YAML text (an indented block or none); a missing required key is an error."""
        found: dict[str, str] = {}
        for line in text.splitlines():
            line = line.strip()
            if not line or line.startswith("#") or ":" not in line:
                continue
            key, _, value = line.partition(":")
            value = value.strip()
            if value[:1] in ("'", '"'):
                value = value[1 : value.index(value[0], 1)]
            else:
                value = value.split(" #")[0].strip()
            found[key.strip()] = value
        missing = [k for k in REQUIRED if k not in found]
        if missing:
            raise ValueError(f"missing settings: {', '.join(missing)}")
        kinds = {"str": str, "int": int, "float": float}
        return cls(**{f.name: kinds[str(f.type)](found[f.name]) for f in fields(cls) if f.name in found})

    @classmethod
    def read(cls, spark, path: str) -> Config:
        return cls.parse("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
