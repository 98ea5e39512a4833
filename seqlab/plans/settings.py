"""Default settings of the extraction and component steps, and path substitution in settings."""

from __future__ import annotations

import copy

from seqlab.functions.text import replace_component_text

# The defaults that the external extraction step expects.
EXTRACTION = {
    "angle_hampel_sig": 3,
    "angle_hampel_span": 0,
    "bg_roi_depth_range": [550, 650],
    "bg_roi_dilate": [10, 10],
    "bg_roi_erode": [1, 1],
    "bg_roi_fill_holes": True,
    "bg_roi_gradient_filter": False,
    "bg_roi_gradient_kernel": 7,
    "bg_roi_gradient_threshold": 3000,
    "bg_roi_index": 0,
    "bg_roi_shape": "ellipse",
    "bg_roi_weights": [1, 0.1, 1],
    "bg_v2": True,
    "cable_filter_iters": 1,
    "cable_filter_shape": "ellipse",
    "cable_filter_size": [3, 3],
    "camera_type": "azure",
    "centroid_hampel_sig": 3,
    "centroid_hampel_span": 0,
    "chunk_overlap": 0,
    "chunk_size": 3000,
    "cluster_type": "local",
    "compress": False,
    "compress_chunk_size": 3000,
    "compress_threads": 3,
    "compute_raw_scalars": False,
    "config_file": None,
    "crop_size": [120, 120],
    "delete": False,
    "detected_true_depth": "auto",
    "dilate_iterations": 1,
    "erode_iterations": 0,
    "flip_classifier": None,
    "flip_classifier_smoothing": 71,
    "fps": 30,
    "frame_dtype": "uint8",
    "frame_trim": [0, 0],
    "graduate_walls": False,
    "manual_set_depth_range": False,
    "mapping": "DEPTH",
    "max_height": 120,
    "min_height": 10,
    "model_smoothing_clips": [0, 0],
    "movie_dtype": "<i2",
    "noise_tolerance": 30,
    "num_frames": None,
    "output_dir": "proc",
    "output_file": None,
    "pixel_format": "gray16le",
    "progress_bar": False,
    "recompute_bg": False,
    "skip_completed": False,
    "spatial_filter_size": [5],
    "tail_filter_iters": 1,
    "tail_filter_shape": "ellipse",
    "tail_filter_size": [15, 15],
    "temporal_filter_size": [0],
    "threads": 8,
    "tracking_model_init": "raw",
    "tracking_model_ll_clip": -100,
    "tracking_model_ll_threshold": -100,
    "tracking_model_mask_threshold": -16,
    "tracking_model_segment": True,
    "use_cc": True,
    "use_plane_bground": False,
    "use_tracking_model": False,
    "widen_radius": 0,
    "write_movie": True,
}

# The defaults that the external component (PCA) step expects.
COMPONENTS = {
    "index": "",
    "output_dir": "_pca",
    "h5_path": "/frames",
    "h5_mask_path": "/frames_mask",
    "pca_path": "/components",
    "output_file": "pca",
    "pca_file": None,
    "pca_file_components": None,
    "pca_file_scores": None,
    "chunk_size": 4000,
    "fps": 30,
    "fill_gaps": True,
    "detrend_window": 0,
    "min_height": 10,
    "max_height": 120,
    "mask_height_threshold": 5,
    "gaussfilter_space": [2.25, 1.5],
    "gaussfilter_time": 0,
    "medfilter_space": 0,
    "medfilter_time": 0,
    "tailfilter_size": [15, 15],
    "tailfilter_shape": "ellipse",
    "use_fft": False,
    "nan_zeroed_frames": True,
    "npcs": 10,
    "rank": 15,
    "train_on_subset": 1,
    "whiten": "all",
    "missing_data": False,
    "missing_data_iters": 10,
    "mask_threshold": -16,
    "recon_pcs": 10,
    "overwrite_pca_train": True,
    "overwrite_pca_apply": True,
    "neighbors": 1,
    "threshold": 0.5,
    "klags": 6,
    "sigma": 3.5,
    "dims": 150,
    "cluster_type": "local",
    "queue": "debug",
    "timeout": 5,
    "nworkers": 1,
    "cores": 1,
    "processes": 1,
    "memory": "15GB",
    "wall_time": "06:00:00",
    "dask_port": "8787",
    "dask_cache_path": "_pca",
    "local_processes": False,
    "camera_type": "azure",
    "verbose": False,
    "progressbar": True,
}


def extraction_settings(flip_classifier: str) -> dict:
    """The extraction defaults with the path of a flip classifier."""
    return copy.deepcopy(EXTRACTION) | {"flip_classifier": flip_classifier}


def component_settings() -> dict:
    """The component defaults."""
    return copy.deepcopy(COMPONENTS)


def apply_path(settings: dict, path: str, *, component: str) -> dict:
    """The settings with ``path`` in place of a path component, in all text values that hold it. Returned, not written."""
    return {k: replace_component_text(v, component, path) if isinstance(v, str) and component in v else v for k, v in settings.items()}
