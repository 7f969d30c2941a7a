"""Column functions: periodic geometry, grids, draws and window frames."""

from .draws import hash_normal, hash_uniform
from .geometry import cell_index, minimum_image, periodic_distance2, wrap
from .numeric import geometric_grid, linear_grid, linear_interpolate, log_interpolate, positive, sinc, three_point_gradient
from .windows import over

__all__ = [
    "cell_index", "geometric_grid", "hash_normal", "hash_uniform", "linear_grid", "linear_interpolate", "log_interpolate",
    "minimum_image", "over", "periodic_distance2", "positive", "sinc", "three_point_gradient", "wrap",
]
