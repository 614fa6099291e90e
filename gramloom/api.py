"""The typed functions: checked constructors and named operations.

Aliasing and workspaces do not exist for immutable relations: the forms with a
workspace are the plain ones, and results never overwrite operands.
"""

from __future__ import annotations

from .operators import level1, level2, level3
from .plans.strategy import BLOCK_WORK, BROADCAST_CELLS  # noqa: F401
from .sources.layout import from_flat, strided
from .types import DimensionMismatch, Matrix, Vector

vector = const_vector = strided
matrix = const_matrix = from_flat


def swap_vectors(first_vector: Vector, second_vector: Vector):
    return level1.swap(first_vector, second_vector)


def copy_vector(source_vector: Vector, destination_vector: Vector) -> Vector:
    return level1.copy(source_vector, destination_vector)


def scale_vector(target_vector: Vector, scale) -> Vector:
    return level1.scal(scale, target_vector)


def scale_vector_into(input_vector: Vector, result_vector: Vector, scale) -> Vector:
    return level1.scal_into(scale, input_vector, result_vector)


def add_scaled_vector(source_vector: Vector, destination_vector: Vector, scale) -> Vector:
    return level1.axpy(scale, source_vector, destination_vector)


def add_scaled_vector_into(source_vector: Vector, input_vector: Vector, result_vector: Vector, scale) -> Vector:
    return level1.axpy_into(scale, source_vector, input_vector, result_vector)


def combine_vectors(source_vector: Vector, destination_vector: Vector, source_scale, destination_scale) -> Vector:
    return level1.axpby(source_scale, source_vector, destination_scale, destination_vector)


def combine_vectors_into(source_vector: Vector, input_vector: Vector, result_vector: Vector, source_scale, input_scale) -> Vector:
    return level1.axpby_into(source_scale, source_vector, input_scale, input_vector, result_vector)


def dot_product(left_vector: Vector, right_vector: Vector):
    return level1.dot(left_vector, right_vector)


def conjugated_dot_product(left_vector: Vector, right_vector: Vector):
    return level1.dotc(left_vector, right_vector)


def euclidean_norm(input_vector: Vector):
    return level1.nrm2(input_vector)


def matrix_vector_multiply_workspace_length(matrix: Matrix) -> int:
    return matrix.m


def matrix_vector_multiply(matrix: Matrix, input_vector: Vector, result_vector: Vector, product_scale=1, result_scale=0) -> Vector:
    return level2.gemv("N", product_scale, matrix, input_vector, result_scale, result_vector)


def matrix_vector_multiply_with_workspace(matrix: Matrix, input_vector: Vector, result_vector: Vector, workspace=None, product_scale=1, result_scale=0) -> Vector:
    return matrix_vector_multiply(matrix, input_vector, result_vector, product_scale, result_scale)


def matrix_multiply_workspace_length(result_matrix: Matrix) -> int:
    return result_matrix.m * result_matrix.n


def matrix_multiply(left_matrix: Matrix, right_matrix: Matrix, result_matrix: Matrix, product_scale=1, result_scale=0) -> Matrix:
    if (left_matrix.m, left_matrix.n, right_matrix.n) != (result_matrix.m, right_matrix.m, result_matrix.n):
        raise DimensionMismatch("shapes of a product")
    return level3.gemm(product_scale, left_matrix, right_matrix, result_scale, result_matrix)


def matrix_multiply_with_workspace(left_matrix: Matrix, right_matrix: Matrix, result_matrix: Matrix, workspace=None, product_scale=1, result_scale=0) -> Matrix:
    return matrix_multiply(left_matrix, right_matrix, result_matrix, product_scale, result_scale)
