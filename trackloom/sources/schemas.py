"""Schemas of the model's tables, as DDL text for readers and writers."""

CAMERAS = "camera_id long, model int, width long, height long, params array<double>, prior_focal_length boolean"
IMAGES = "image_id long, name string, camera_id long, qvec array<double>, tvec array<double>, registered boolean"
KEYPOINTS = "image_id long, idx int, x float, y float, a11 float, a12 float, a21 float, a22 float"
DESCRIPTORS = "image_id long, idx int, descriptor array<short>"
MATCHES = "pair_id long, image_id1 long, image_id2 long, idx1 int, idx2 int"
TWO_VIEW = "pair_id long, image_id1 long, image_id2 long, n_rows int, config int, F array<double>, E array<double>, H array<double>, qvec array<double>, tvec array<double>"
POINTS2D = "image_id long, idx int, x double, y double, point3d_id long"
POINTS3D = "point3d_id long, x double, y double, z double, r int, g int, b int, error double"
TRACKS = "point3d_id long, image_id long, idx int"
LIDAR = "x float, y float, z float, nx float, ny float, nz float"
JOURNAL = "epoch long, revision long, kind string, entity long, reason string"

#: Camera model names and their numbers of parameters, by model id.
CAMERA_MODELS = {
    0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8),
    6: ("FULL_OPENCV", 12), 7: ("FOV", 5), 8: ("SIMPLE_RADIAL_FISHEYE", 4), 9: ("RADIAL_FISHEYE", 5), 10: ("THIN_PRISM_FISHEYE", 12),
}
