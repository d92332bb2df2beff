"""All queries of the library; importing this package registers them."""

from . import dual_meshes, files, free_nodes, fusion, images, keys, ray_maps, records, stateful, tracking, voxels  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
