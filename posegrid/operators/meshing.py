"""Iso-surfaces of a voxel field by marching tetrahedra: cube corners joined, triangles by rule, no case table.

Each cube is cut into six tetrahedra around its diagonal. A tetrahedron's surface follows from which of its
corners lie inside, so the triangles come from a rule over sign patterns instead of a table of 256 cases; the
surface is closed across cubes, with more and smaller triangles.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import cube_corners

#: Corners of each tetrahedron: along the cube's diagonal, one step on each axis in turn. Corner number is 4x + 2y + z.
TETRAHEDRA = [[0, a, a + b, 7] for a, b, _ in permutations((4, 2, 1))]


def _patterns() -> list[tuple[int, list[tuple[tuple[int, int], ...]]]]:
    """For each pattern of inside corners: triangles as edges (inside corner, outside corner)."""
    out = []
    for bits in range(1, 15):
        ins = [i for i in range(4) if bits >> i & 1]
        outs = [i for i in range(4) if not bits >> i & 1]
        if len(ins) == 2:
            (a, b), (c, d) = ins, outs
            tris = [((a, c), (a, d), (b, d)), ((a, c), (b, d), (b, c))]
        else:
            one, three = (ins[0], outs) if len(ins) == 1 else (outs[0], ins)
            edge = (lambda o, one=one: (one, o)) if len(ins) == 1 else (lambda o, one=one: (o, one))
            tris = [tuple(edge(o) for o in three)]
        out.append((bits, tris))
    return out


def marching_tetrahedra(voxels: DataFrame, edge: float, level: float = 0.0) -> DataFrame:
    """Triangles (cx, cy, cz, tri, ax, ..., cz_) where the field (cx, cy, cz, value) passes ``level``; only cubes with all corners observed."""
    cubes = cube_corners(voxels)
    tets = cubes.withColumn("tet", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.array(*map(F.lit, t)).alias("c")) for i, t in enumerate(TETRAHEDRA)])))
    value = lambda k: F.element_at("values", F.col("tet.c")[k] + 1).cast("double")
    for k in range(4):
        tets = tets.withColumn(f"v{k}", value(k))
    inside = sum((F.when(F.col(f"v{k}") < level, 1 << k).otherwise(0) for k in range(4)), F.lit(0))
    tets = tets.withColumn("bits", inside).filter("bits > 0 and bits < 15")
    rules = F.create_map(*[x for bits, tris in _patterns() for x in (F.lit(bits), F.array(*[F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in t]) for t in tris]))])
    tris = tets.select("*", F.posexplode(rules[F.col("bits")]).alias("n", "t"))
    values = F.array(*[F.col(f"v{k}") for k in range(4)])
    corner = lambda k, shift, axis: (F.col(axis) + F.call_function("shiftright", F.col("tet.c")[k], F.lit(shift)).bitwiseAND(1) + 0.5) * edge

    def vertex(i: int, axis: str, shift: int) -> Column:
        a, b = F.col("t")[i]["a"], F.col("t")[i]["b"]
        va, vb = values[a], values[b]
        u = (F.lit(level) - va) / (vb - va)
        return corner(a, shift, axis) + u * (corner(b, shift, axis) - corner(a, shift, axis))

    cols = [vertex(i, axis, shift).alias(f"{n}{axis[1]}") for i, n in enumerate("pqr") for axis, shift in (("cx", 2), ("cy", 1), ("cz", 0))]
    return tris.select("cx", "cy", "cz", (F.col("tet.i") * 2 + F.col("n")).alias("tri"), *cols)


def mesh_expand(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """One row for each corner of each triangle: (mesh, tri, corner, x, y, z) from vertices (mesh, v, x, y, z) and triangles (mesh, tri, indices)."""
    return triangles.select("mesh", "tri", F.posexplode("indices").alias("corner", "v")).join(vertices, ["mesh", "v"]).drop("v")
