"""Geospatial predicates as column arithmetic."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.fields import Fields

EARTH_RADIUS_M = 6_371_000.0
_LON = ("lng", "lon", "longitude", "x")
_LAT = ("lat", "latitude", "y")


def coordinates(fields: Fields, path: str) -> tuple[Column, Column]:
    """(longitude, latitude) of a GeoJSON point, a pair, or a struct with named coordinates."""
    kind = fields.type_of(path)
    if isinstance(kind, T.ArrayType):
        return tuple(F.get(fields.col(path), i).cast("double") for i in (0, 1))
    if isinstance(kind, T.StructType):
        names = kind.fieldNames()
        if "coordinates" in names:
            return tuple(F.get(fields.col(path + ".coordinates"), i).cast("double") for i in (0, 1))
        lon, lat = ([n for n in some if n in names] for some in (_LON, _LAT))
        if lon and lat:
            return fields.col(f"{path}.{lon[0]}").cast("double"), fields.col(f"{path}.{lat[0]}").cast("double")
    return F.lit(None).cast("double"), F.lit(None).cast("double")


def haversine(lon: Column, lat: Column, to: tuple[float, float]) -> Column:
    """Metres on a sphere."""
    x, y = F.lit(float(to[0])), F.lit(float(to[1]))
    dlat, dlon = F.radians(y - lat), F.radians(x - lon)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(y)) * F.pow(F.sin(dlon / 2), 2)
    a = F.when(a > 1, F.lit(1.0)).otherwise(a)  # stays null without coordinates
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def euclidean(lon: Column, lat: Column, to: tuple[float, float]) -> Column:
    return F.sqrt(F.pow(lon - float(to[0]), 2) + F.pow(lat - float(to[1]), 2))


def point_of(value: object) -> tuple[float, float]:
    if isinstance(value, dict):
        if "$geometry" in value:
            return point_of(value["$geometry"])
        if "coordinates" in value:
            return tuple(map(float, value["coordinates"][:2]))
        lon, lat = (next((value[n] for n in some if n in value), None) for some in (_LON, _LAT))
        if lon is not None and lat is not None:
            return float(lon), float(lat)
    if isinstance(value, (list, tuple)) and len(value) >= 2:
        return float(value[0]), float(value[1])
    raise ValueError(f"not a point: {value!r}")


def in_ring(lon: Column, lat: Column, ring: list) -> Column:
    """Ray casting: whether a ray from the point crosses the ring an odd number of times."""
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 == y2:
            continue
        crosses = ((F.lit(float(y1)) > lat) != (F.lit(float(y2)) > lat)) & (lon < (lat - float(y1)) * float(x2 - x1) / float(y2 - y1) + float(x1))
        inside = inside != crosses
    return inside


def in_polygon(lon: Column, lat: Column, rings: list) -> Column:
    """In the first ring and in none of the others, which are holes."""
    out = in_ring(lon, lat, rings[0])
    for hole in rings[1:]:
        out = out & ~in_ring(lon, lat, hole)
    return out


def within(lon: Column, lat: Column, shape: dict) -> Column:
    if "$box" in shape:
        (x1, y1), (x2, y2) = shape["$box"]
        return lon.between(float(min(x1, x2)), float(max(x1, x2))) & lat.between(float(min(y1, y2)), float(max(y1, y2)))
    if "$polygon" in shape:
        return in_ring(lon, lat, [tuple(p) for p in shape["$polygon"]])
    if "$center" in shape:
        centre, radius = shape["$center"]
        return euclidean(lon, lat, point_of(centre)) <= float(radius)
    if "$centerSphere" in shape:
        centre, radians = shape["$centerSphere"]
        return haversine(lon, lat, point_of(centre)) <= float(radians) * EARTH_RADIUS_M
    geometry = shape.get("$geometry", {})
    if geometry.get("type") == "Polygon":
        return in_polygon(lon, lat, geometry["coordinates"])
    if geometry.get("type") == "MultiPolygon":
        out = F.lit(False)
        for rings in geometry["coordinates"]:
            out = out | in_polygon(lon, lat, rings)
        return out
    raise ValueError(f"unknown shape {sorted(shape)}")


def _segments(ring: list) -> list[tuple]:
    return list(zip(ring, ring[1:] + ring[:1] if ring[0] != ring[-1] else ring[1:]))


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """On which side of the line from a to b the point lies: its sign."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether two segments meet, ends included."""
    s1, s2 = _side(ax, ay, bx, by, cx, cy), _side(ax, ay, bx, by, dx, dy)
    s3, s4 = _side(cx, cy, dx, dy, ax, ay), _side(cx, cy, dx, dy, bx, by)
    between = lambda x1, y1, x2, y2, x, y: x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
    touch = (s1 == 0) & between(ax, ay, bx, by, cx, cy) | (s2 == 0) & between(ax, ay, bx, by, dx, dy) | (s3 == 0) & between(cx, cy, dx, dy, ax, ay) | (s4 == 0) & between(cx, cy, dx, dy, bx, by)
    return (F.signum(s1) * F.signum(s2) < 0) & (F.signum(s3) * F.signum(s4) < 0) | touch


def rings_intersect(rings: Column, shape: list) -> Column:
    """Whether a stored polygon (an array of rings of points) meets a polygon given as rings: some of their edges cross, or one
    holds a corner of the other, outside its holes."""
    ring = F.get(rings, 0)
    corner = lambda r, i, k: F.get(F.get(r, i), k).cast("double")
    edges = [(float(x1), float(y1), float(x2), float(y2)) for r in shape for (x1, y1), (x2, y2) in _segments([tuple(p) for p in r])]

    def crossed(r: Column) -> Column:
        def at(i: Column) -> Column:
            own = [corner(r, i + j, k) for j in (0, 1) for k in (0, 1)]
            return reduce(or_, [_cross(*map(F.lit, e), *own) for e in edges])

        return F.exists(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(r) - 2)), at)

    out = F.exists(rings, crossed)
    own_corner = in_polygon(corner(ring, F.lit(0), 0), corner(ring, F.lit(0), 1), shape)
    px, py = float(shape[0][0][0]), float(shape[0][0][1])

    def holds(r: Column) -> Column:
        def odd(i: Column) -> Column:
            ax, ay, bx, by = (corner(r, i + j, k) for j in (0, 1) for k in (0, 1))
            return F.coalesce(((ay > py) != (by > py)) & (F.lit(px) < F.try_divide((F.lit(py) - ay) * (bx - ax), by - ay) + ax), F.lit(False))

        return F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(r) - 2)), odd)) % 2 == 1

    holes = F.slice(rings, F.lit(2), F.greatest(F.lit(0), F.size(rings) - 1))
    inside = holds(ring) & ~F.exists(holes, holds)
    return F.coalesce((F.size(ring) >= 4) & (out | own_corner | inside), F.lit(False))


def stored_rings(fields: Fields, path: str) -> Column | None:
    """The rings of a stored GeoJSON polygon; None if the field holds no polygons."""
    kind = fields.type_of(path)
    if isinstance(kind, T.StructType) and "coordinates" in kind.fieldNames():
        deep = kind["coordinates"].dataType
        if isinstance(deep, T.ArrayType) and isinstance(deep.elementType, T.ArrayType) and isinstance(deep.elementType.elementType, T.ArrayType):
            return fields.col(path + ".coordinates")
    return None


def as_rings(geometry: dict) -> list[list]:
    """The polygons, each as rings, that a geometry stands for; a point or a line is a polygon without area."""
    kind, at = geometry["type"], geometry["coordinates"]
    if kind == "Polygon":
        return [at]
    if kind == "MultiPolygon":
        return at
    if kind == "Point":
        return [[[at, at, at, at]]]
    if kind == "LineString":
        return [[[*at, *at[-2::-1]]]]
    raise ValueError(f"unknown geometry {kind}")


def in_range(lon: Column, lat: Column) -> Column:
    """Whether coordinates are on the sphere."""
    return lon.between(-180, 180) & lat.between(-90, 90)


def intersects(lon: Column, lat: Column, geometry: dict) -> Column:
    """Whether a stored point meets the geometry."""
    if geometry["type"] == "Point":
        x, y = point_of(geometry)
        return (lon == x) & (lat == y)
    if geometry["type"] == "LineString":
        out = F.lit(False)
        for (x1, y1), (x2, y2) in zip(geometry["coordinates"], geometry["coordinates"][1:]):
            on_line = F.abs((lon - x1) * float(y2 - y1) - (lat - y1) * float(x2 - x1)) < 1e-9
            out = out | on_line & lon.between(float(min(x1, x2)), float(max(x1, x2))) & lat.between(float(min(y1, y2)), float(max(y1, y2)))
        return out
    return within(lon, lat, {"$geometry": geometry})


def distance(fields: Fields, path: str, ops: dict) -> tuple[Column, float, float]:
    """Distance to the `$near` or `$nearSphere` point, and the least and greatest allowed."""
    op = "$near" if "$near" in ops else "$nearSphere"
    spec = ops[op]
    lon, lat = coordinates(fields, path)
    geo_json = isinstance(spec, dict) and "$geometry" in spec
    inner = spec if isinstance(spec, dict) else {}
    measure = haversine if geo_json or op == "$nearSphere" else euclidean
    low = inner.get("$minDistance", ops.get("$minDistance", 0.0))
    high = inner.get("$maxDistance", ops.get("$maxDistance", float("inf")))
    if measure is haversine:
        x, y = point_of(spec)
        if not (-180 <= x <= 180 and -90 <= y <= 90):
            raise ValueError(f"({x}, {y}) is not on the sphere")
        lon, lat = F.when(in_range(lon, lat), lon), F.when(in_range(lon, lat), lat)
    return measure(lon, lat, point_of(spec)), float(low), float(high)


def matches(fields: Fields, path: str, ops: dict) -> Column:
    out = F.lit(True)
    if "$near" in ops or "$nearSphere" in ops:
        far, low, high = distance(fields, path, ops)
        out = out & (far >= low) & (far <= high)
    lon, lat = coordinates(fields, path)
    if "$geoWithin" in ops:
        out = out & within(lon, lat, ops["$geoWithin"])
    if "$geoIntersects" in ops:
        geometry, rings = ops["$geoIntersects"]["$geometry"], stored_rings(fields, path)
        if rings is not None:
            meets = F.lit(False)
            for polygon in as_rings(geometry):
                meets = meets | rings_intersect(rings, polygon)
            out = out & meets
        else:
            out = out & intersects(lon, lat, geometry)
    return out


def near(df, path: str, point, max_distance: float = float("inf"), min_distance: float = 0.0, spherical: bool = True):
    """Rows within the distances, nearest first, with the column `distance`. On the sphere, coordinates outside it have none."""
    lon, lat = coordinates(Fields(df), path)
    if spherical:
        lon, lat = F.when(in_range(lon, lat), lon), F.when(in_range(lon, lat), lat)
    far = (haversine if spherical else euclidean)(lon, lat, point_of(point))
    out = df.withColumn("distance", far).where((F.col("distance") >= min_distance) & (F.col("distance") <= max_distance))
    return out.orderBy("distance")
