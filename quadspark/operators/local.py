"""Per-tile geometry that is sequential by nature: Delaunay and greedy meshes, simplification, texture parameterisation.

The functions on numpy arrays do one tile; the DataFrame functions run them for each mesh with `applyInPandas`, so a task holds
one tile at a time and tiles run in parallel.  Keep tiles to some thousands of vertices.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .mesh import M

SCALE = 1 << 32  # coordinates as integers, so that the predicates are exact


class Triangulation:
    """Incremental Delaunay triangulation over integer points: faces by number and by directed edge."""

    def __init__(self):
        self.points: list[tuple[int, int]] = []
        self.faces: dict[int, tuple[int, int, int]] = {}
        self.edge: dict[tuple[int, int], int] = {}
        self.next = 0
        self.last = 0

    def orient(self, a: int, b: int, c: int) -> int:
        (ax, ay), (bx, by), (cx, cy) = self.points[a], self.points[b], self.points[c]
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    def inside_circle(self, face: int, p: int) -> bool:
        px, py = self.points[p]
        m = [(x - px, y - py) for x, y in (self.points[i] for i in self.faces[face])]
        s = [x * x + y * y for x, y in m]
        (ax, ay), (bx, by), (cx, cy) = m
        return ax * (by * s[2] - cy * s[1]) - ay * (bx * s[2] - cx * s[1]) + s[0] * (bx * cy - cx * by) > 0

    def add(self, a: int, b: int, c: int) -> int:
        f = self.next
        self.next += 1
        self.faces[f] = (a, b, c)
        for e in ((a, b), (b, c), (c, a)):
            self.edge[e] = f
        self.last = f
        return f

    def drop(self, f: int) -> None:
        a, b, c = self.faces.pop(f)
        for e in ((a, b), (b, c), (c, a)):
            if self.edge.get(e) == f:
                del self.edge[e]

    def locate(self, p: int) -> int | None:
        """Face that holds p, by walking; the start is the face made last."""
        f, seen = self.last if self.last in self.faces else next(iter(self.faces)), 0
        while True:
            a, b, c = self.faces[f]
            for u, v in ((a, b), (b, c), (c, a)):
                if self.orient(u, v, p) < 0:
                    f = self.edge.get((v, u))
                    if f is None:
                        return None
                    break
            else:
                return f
            seen += 1
            if seen > 4 * len(self.faces) + 16:
                return None

    def insert(self, p: int) -> tuple[list[int], list[int]]:
        """Faces removed and made; none if p lies outside or on a vertex."""
        f = self.locate(p)
        if f is None or self.points[p] in (self.points[i] for i in self.faces[f]):
            return [], []
        hole, todo, rim = {f}, [f], []
        while todo:
            a, b, c = self.faces[todo.pop()]
            for u, v in ((a, b), (b, c), (c, a)):
                n = self.edge.get((v, u))
                if n in hole:
                    continue
                if n is not None and self.inside_circle(n, p):
                    hole.add(n)
                    todo.append(n)
        for g in hole:
            a, b, c = self.faces[g]
            rim += [(u, v) for u, v in ((a, b), (b, c), (c, a)) if self.edge.get((v, u)) not in hole]
        for g in hole:
            self.drop(g)
        return list(hole), [self.add(u, v, p) for u, v in rim if self.orient(u, v, p) > 0]


def delaunay(xy: np.ndarray) -> np.ndarray:
    """Faces (counter-clockwise indices) of the Delaunay triangulation of points; of points at one place the first is used."""
    q = np.rint((np.asarray(xy, dtype=np.float64) - np.min(xy, axis=0, initial=0)) * SCALE) if len(xy) else np.zeros((0, 2))
    t = Triangulation()
    t.points = [(int(x), int(y)) for x, y in q]
    first: dict[tuple[int, int], int] = {}
    for i, p in enumerate(t.points):
        first.setdefault(p, i)
    order = sorted(first.values(), key=lambda i: t.points[i])
    if len(order) < 3:
        return np.zeros((0, 3), dtype=np.int64)
    xs, ys = [p[0] for p in t.points], [p[1] for p in t.points]
    size = max(max(xs) - min(xs), max(ys) - min(ys), 1) << 24
    cx, cy, n = (max(xs) + min(xs)) // 2, (max(ys) + min(ys)) // 2, len(t.points)
    t.points += [(cx - 2 * size, cy - size), (cx + 2 * size, cy - size), (cx, cy + 2 * size)]
    t.add(n, n + 1, n + 2)
    for i in order:
        t.insert(i)
    return np.array([f for f in t.faces.values() if max(f) < n], dtype=np.int64).reshape(-1, 3)


def terra(z: np.ndarray, max_error: float, max_points: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Greedy insertion mesh of a height grid (nan: missing): vertices (row, col, z) and faces looking up.

    Starts from the four corners and puts in the pixel with the largest vertical error until none exceeds `max_error`.  A
    corner without a height takes that of the nearest pixel that has one."""
    h, w = z.shape
    valid = np.argwhere(np.isfinite(z))
    if h < 2 or w < 2 or not len(valid):
        return np.zeros((0, 3)), np.zeros((0, 3), dtype=np.int64)
    t, heights = Triangulation(), []

    def vertex(r: int, c: int) -> int:
        v = z[r, c]
        if not np.isfinite(v):
            r2, c2 = valid[np.argmin(((valid - (r, c)) ** 2).sum(axis=1))]
            v = z[r2, c2]
        t.points.append((c, h - 1 - r))
        heights.append(float(v))
        return len(t.points) - 1

    def worst(f: int) -> tuple[float, int, int]:
        (ax, ay), (bx, by), (cx, cy) = (t.points[i] for i in t.faces[f])
        za, zb, zc = (heights[i] for i in t.faces[f])
        x, y = np.arange(min(ax, bx, cx), max(ax, bx, cx) + 1), np.arange(min(ay, by, cy), max(ay, by, cy) + 1)[:, None]
        d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        u = ((cx - bx) * (y - by) - (cy - by) * (x - bx)) / d
        v = ((ax - cx) * (y - cy) - (ay - cy) * (x - cx)) / d
        k = 1 - u - v
        plane = u * za + v * zb + k * zc
        own = z[h - 1 - y[:, 0][:, None], x[None, :]]
        e = np.where((u >= -1e-12) & (v >= -1e-12) & (k >= -1e-12) & np.isfinite(own), np.abs(own - plane), -1.0)
        i = int(np.argmax(e))
        return float(e.flat[i]), h - 1 - int(y[i // e.shape[1], 0]), int(x[i % e.shape[1]])

    sw, se, ne, nw = vertex(h - 1, 0), vertex(h - 1, w - 1), vertex(0, w - 1), vertex(0, 0)
    queue: list[tuple[float, int, int, int]] = []

    def push(faces: list[int]) -> None:
        for f in faces:
            e, r, c = worst(f)
            if e > max_error:
                heapq.heappush(queue, (-e, f, r, c))

    push([t.add(sw, se, ne), t.add(sw, ne, nw)])
    while queue and (max_points is None or len(t.points) < max_points):
        _, f, r, c = heapq.heappop(queue)
        if f not in t.faces:
            continue  # replaced meanwhile
        t.last = f
        _, made = t.insert(vertex(r, c))
        push(made)
    v = np.array([(h - 1 - y, x, k) for (x, y), k in zip(t.points, heights, strict=True)], dtype=np.float64)
    return v, np.array(list(t.faces.values()), dtype=np.int64)


def simplify(
    xyz: np.ndarray, faces: np.ndarray, ratio: float | None = 0.5, max_error: float | None = None, uv: np.ndarray | None = None, *,
    vertex_ratio: float | None = None, face_ratio: float | None = None, distance: float | None = None, relative_distance: float | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Edge collapse by quadric error until one of the conditions given holds: `ratio` of the edges, `vertex_ratio` of the
    vertices or `face_ratio` of the faces is left, or the next collapse costs more than `max_error` squared.

    `distance` bounds how far a point of the given surface may be from the new one, `relative_distance` the same as a share of
    the longest side of the mesh's box: it is measured each time a tenth of the edges has gone, and what was done since
    the last measurement is taken back where the bound is exceeded.  Edges that touch a border vertex stay, so neighbouring
    tiles keep fitting; a collapse that would turn a face over, or fold the surface onto itself, is skipped.  Texture
    coordinates move along the collapsed edge."""
    if relative_distance is not None and len(xyz):
        own = relative_distance * float(np.ptp(xyz, axis=0).max())
        distance = own if distance is None else min(distance, own)
    p = np.array(xyz, dtype=np.float64)
    uv = None if uv is None else np.array(uv, dtype=np.float64)
    f = {i: list(map(int, t)) for i, t in enumerate(faces)}
    at: list[set[int]] = [set() for _ in p]
    for i, t in f.items():
        for v in t:
            at[v].add(i)
    count: dict[tuple[int, int], int] = {}
    for t in f.values():
        for u, v in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            e = (min(u, v), max(u, v))
            count[e] = count.get(e, 0) + 1
    border = {v for e, n in count.items() if n != 2 for v in e}
    q = np.zeros((len(p), 4, 4))
    for t in f.values():
        n = np.cross(p[t[1]] - p[t[0]], p[t[2]] - p[t[0]])
        length = np.linalg.norm(n)
        if length > 0:
            n = np.append(n / length, -np.dot(n / length, p[t[0]]))
            for v in t:
                q[v] += np.outer(n, n)
    stamp = [0] * len(p)

    def cost(u: int, v: int) -> tuple[float, np.ndarray, float]:
        k = q[u] + q[v]
        try:
            x = np.linalg.solve(k[:3, :3] + 1e-9 * np.trace(k[:3, :3]) * np.eye(3), -k[:3, 3] + 1e-9 * np.trace(k[:3, :3]) * (p[u] + p[v]) / 2)
        except np.linalg.LinAlgError:
            x = (p[u] + p[v]) / 2
        d = p[v] - p[u]
        s = float(np.clip(np.dot(x - p[u], d) / max(np.dot(d, d), 1e-300), 0, 1))
        h = np.append(x, 1.0)
        return max(0.0, float(h @ k @ h)), x, s

    queue: list[tuple[float, int, int, int, int]] = []

    def push(u: int, v: int) -> None:
        if u not in border and v not in border:
            heapq.heappush(queue, (cost(u, v)[0], u, v, stamp[u], stamp[v]))

    for u, v in count:
        push(u, v)
    left, vertices, n_faces = len(count), len({v for t in f.values() for v in t}), len(f)
    least = (0 if ratio is None else ratio * left, 0 if vertex_ratio is None else vertex_ratio * vertices, 0 if face_ratio is None else face_ratio * n_faces)

    def state() -> tuple:
        return p.copy(), None if uv is None else uv.copy(), dict(f), left

    def close() -> bool:
        mesh = np.array(list(f.values()), dtype=np.int64).reshape(-1, 3)
        return surface_distance(xyz, faces, p, mesh, distance / 50, 0.98 * distance) <= 0.98 * distance

    good = state() if distance is not None else None  # the last surface known to keep the distance
    while queue and left > least[0] and vertices > least[1] and len(f) > least[2]:
        if good is not None and left <= 0.9 * good[3]:
            if not close():
                break
            good = state()
        c, u, v, su, sv = heapq.heappop(queue)
        if (stamp[u], stamp[v]) != (su, sv) or not at[u] or not at[v]:
            continue
        if max_error is not None and c > max_error * max_error:
            break
        both = at[u] & at[v]
        ring = lambda a: {w for i in at[a] for w in f[i]} - {a}
        if len(both) != 2 or len(ring(u) & ring(v)) != 2:
            continue
        _, x, s = cost(u, v)
        ok = True
        for i in (at[u] | at[v]) - both:
            t = f[i]
            old = np.cross(p[t[1]] - p[t[0]], p[t[2]] - p[t[0]])
            w = [x if k in (u, v) else p[k] for k in t]
            new = np.cross(w[1] - w[0], w[2] - w[0])
            if np.dot(old, new) <= 0.2 * np.linalg.norm(old) * np.linalg.norm(new) or (old[2] > 0) != (new[2] > 0):
                ok = False
                break
        if not ok:
            continue
        p[u] = x
        if uv is not None:
            uv[u] = uv[u] + (uv[v] - uv[u]) * s
        q[u] += q[v]
        for i in both:
            for w in f.pop(i):
                at[w].discard(i)
        for i in at[v]:
            f[i] = [u if w == v else w for w in f[i]]
            at[u].add(i)
        at[v] = set()
        stamp[u] += 1
        stamp[v] += 1
        left -= 3
        vertices -= 1
        for w in ring(u):
            push(min(u, w), max(u, w))
    if good is not None and left < good[3] and not close():
        p, uv, f, left = good
    used = sorted({v for t in f.values() for v in t})
    number = {v: i for i, v in enumerate(used)}
    out = np.array([[number[v] for v in f[i]] for i in sorted(f)], dtype=np.int64).reshape(-1, 3)
    return p[used], out, None if uv is None else uv[used]


def border_loop(faces: np.ndarray) -> list[int]:
    """The longest closed loop of border vertices, in the faces' orientation."""
    directed = {(int(u), int(v)) for t in faces for u, v in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
    follow = {u: v for u, v in directed if (v, u) not in directed}
    best: list[int] = []
    while follow:
        start = next(iter(follow))
        loop, at = [], start
        while at in follow:
            loop.append(at)
            at = follow.pop(at)
        if at == start and len(loop) > len(best):
            best = loop
    return best


def uv_map(xyz: np.ndarray, faces: np.ndarray, weights: str = "conformal", border: str = "circle") -> np.ndarray:
    """Texture coordinates of a disk-like mesh: its border on a circle or square by length, inner vertices by a convex (`tutte`,
    `mean_value`) or discrete `conformal` or `authalic` combination of their neighbours.  Without a border all are 0.5."""
    p, n = np.asarray(xyz, dtype=np.float64), len(xyz)
    out = np.full((n, 2), 0.5)
    loop = border_loop(faces)
    if len(loop) < 3:
        return out
    step = np.linalg.norm(p[loop] - p[np.roll(loop, -1)], axis=1)
    s = np.concatenate(([0.0], np.cumsum(step)[:-1])) / max(step.sum(), 1e-300)
    if border == "circle":
        out[loop] = np.stack((0.5 + 0.5 * np.cos(2 * np.pi * s), 0.5 + 0.5 * np.sin(2 * np.pi * s)), axis=1)
    else:
        k, r = (s * 4).astype(int) % 4, s * 4 % 1
        out[loop] = np.stack((np.choose(k, (r, np.ones_like(r), 1 - r, np.zeros_like(r))), np.choose(k, (np.zeros_like(r), r, np.ones_like(r), 1 - r))), axis=1)
    w: dict[tuple[int, int], float] = {}
    for t in faces:
        for i in range(3):
            a, b, c = int(t[i]), int(t[(i + 1) % 3]), int(t[(i + 2) % 3])  # the angle at a lies opposite bc
            u, v = p[b] - p[a], p[c] - p[a]
            lu, lv = max(np.linalg.norm(u), 1e-300), max(np.linalg.norm(v), 1e-300)
            angle = np.arccos(np.clip(np.dot(u, v) / (lu * lv), -1, 1))
            cot = 1 / max(np.tan(angle), 1e-9) if angle < np.pi / 2 else np.cos(angle) / max(np.sin(angle), 1e-9)
            if weights == "tutte":
                w[a, b] = w[a, c] = 1.0
            elif weights == "mean_value":
                h = np.tan(angle / 2)
                w[a, b] = w.get((a, b), 0.0) + h / lu
                w[a, c] = w.get((a, c), 0.0) + h / lv
            elif weights == "authalic":  # by the angles at the neighbour, over its squared distance
                w[b, a] = w.get((b, a), 0.0) + cot / (lu * lu)
                w[c, a] = w.get((c, a), 0.0) + cot / (lv * lv)
            else:
                w[b, c] = w.get((b, c), 0.0) + cot
                w[c, b] = w.get((c, b), 0.0) + cot
    fixed = np.zeros(n, dtype=bool)
    fixed[loop] = True
    keys = np.array([k for k in w if not fixed[k[0]]], dtype=np.int64).reshape(-1, 2)
    if not len(keys):
        return out
    val = np.maximum(np.array([w[tuple(k)] for k in keys.tolist()]), 1e-9)
    total = np.bincount(keys[:, 0], val, n)
    val = val / total[keys[:, 0]]
    for _ in range(20 * int(np.sqrt(n)) + 200):  # each vertex to the mean of its neighbours: convergent for positive weights
        new = np.stack([np.bincount(keys[:, 0], val * out[keys[:, 1], d], n) for d in (0, 1)], axis=1)
        new = np.where((total > 0)[:, None] & ~fixed[:, None], new, out)
        done = np.abs(new - out).max() < 1e-10
        out = new
        if done:
            break
    return np.clip(out, 0, 1)


def _to_triangles(x: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of points to triangles; the leading dimensions broadcast."""
    dot = lambda u, v: (u * v).sum(axis=-1)
    ab, ac, ap = b - a, c - a, x - a
    n = np.cross(ab, ac)
    nn = np.maximum(dot(n, n), 1e-300)
    v, w = dot(np.cross(ap, ac), n) / nn, dot(np.cross(ab, ap), n) / nn
    best = np.where((v >= 0) & (w >= 0) & (v + w <= 1) & (nn > 1e-300), dot(ap, n) ** 2 / nn, np.inf)
    for p, d in ((a, ab), (a, ac), (b, c - b)):
        s = np.clip(dot(x - p, d) / np.maximum(dot(d, d), 1e-300), 0, 1)
        e = p + d * s[..., None] - x
        best = np.minimum(best, dot(e, e))
    return best


def _near_order(x: np.ndarray, block: int) -> np.ndarray:
    """An order in which each run of `block` points lies close together."""
    k = max(1, int(np.sqrt(len(x) / block)))
    cell = np.floor((x - x.min(axis=0)) / np.maximum(np.ptp(x, axis=0), 1e-300) * k).astype(np.int64).clip(0, k - 1)
    return np.lexsort((x[:, 2], cell[:, 1], cell[:, 0]))


class _Surface:
    """Nearest triangles of a mesh: triangles in blocks with boxes; for each point the block whose box is nearest is looked at
    first, then those whose boxes are nearer than the triangle found."""

    BLOCK = 8

    def __init__(self, xyz: np.ndarray, faces: np.ndarray):
        t = np.asarray(xyz, dtype=np.float64)[faces]
        t = t[_near_order(t.mean(axis=1), self.BLOCK)]
        self.t = np.concatenate((t, np.repeat(t[-1:], -len(t) % self.BLOCK, axis=0)))  # whole blocks
        at = np.arange(0, len(self.t), self.BLOCK)
        self.lo, self.hi = np.minimum.reduceat(self.t.min(axis=1), at), np.maximum.reduceat(self.t.max(axis=1), at)

    def _in_blocks(self, x: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d, who = np.empty(len(x)), np.empty(len(x), dtype=np.int64)
        for i in range(0, len(x), 4096):
            ids = block[i : i + 4096, None] * self.BLOCK + np.arange(self.BLOCK)
            e = _to_triangles(x[i : i + 4096, None], *(self.t[ids, k] for k in range(3)))
            j = e.argmin(axis=1)[:, None]
            d[i : i + 4096], who[i : i + 4096] = np.take_along_axis(e, j, 1)[:, 0], np.take_along_axis(ids, j, 1)[:, 0]
        return d, who

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance of each point and the triangle (an index into `t`) that has it."""
        d, who = np.empty(len(x)), np.empty(len(x), dtype=np.int64)
        step = max(1, (1 << 21) // len(self.lo))
        for i in range(0, len(x), step):
            p = x[i : i + step]
            box = sum(np.maximum(np.maximum(self.lo[:, k] - p[:, k, None], p[:, k, None] - self.hi[:, k]), 0) ** 2 for k in range(3))
            first = box.argmin(axis=1)
            best, at = self._in_blocks(p, first)
            more = box < best[:, None]
            more[np.arange(len(p)), first] = False
            q, block = np.nonzero(more)
            if len(q):
                e, ids = self._in_blocks(p[q], block)
                last = np.lexsort((-e, q))  # the least of each point comes last and stays
                least, who_least = np.full(len(p), np.inf), np.zeros(len(p), dtype=np.int64)
                least[q[last]], who_least[q[last]] = e[last], ids[last]
                at, best = np.where(least < best, who_least, at), np.minimum(least, best)
            d[i : i + step], who[i : i + step] = np.sqrt(best), at
        return d, who


def hausdorff(xyz: np.ndarray, target: np.ndarray, faces: np.ndarray) -> float:
    """Largest distance of points to a mesh; infinite to a mesh without faces."""
    if not len(xyz):
        return 0.0
    return float(_Surface(target, faces).nearest(np.asarray(xyz, dtype=np.float64))[0].max()) if len(faces) else float("inf")


def surface_distance(xyz: np.ndarray, faces: np.ndarray, target: np.ndarray, target_faces: np.ndarray, tolerance: float, bound: float | None = None) -> float:
    """Largest distance of any point of a surface to another (one-sided Hausdorff distance), too small by `tolerance` at most.

    Triangles are halved along their sides until none can hold a larger distance: within a piece it is at most that of the
    middle plus the piece's radius, and at most the largest of its corners' distances to one and the same triangle.  With a
    `bound` the search ends at the first distance above it, and pieces that stay below it are not refined."""
    if not len(faces):
        return 0.0
    if not len(target_faces):
        return float("inf")
    other = _Surface(target, target_faces)
    t = np.asarray(xyz, dtype=np.float64)[faces]
    found = 0.0
    while len(t):
        keep = []
        for part in np.array_split(t, -(-len(t) // 8192)):  # bounded memory
            points, which = np.unique(part.reshape(-1, 3), axis=0, return_inverse=True)
            corners, who = (r[which.reshape(-1, 3)] for r in other.nearest(points))
            mid = part.mean(axis=1)
            centre, _ = other.nearest(mid)
            found = max(found, float(corners.max()), float(centre.max()))
            if bound is not None and found > bound:
                return found
            radius = np.linalg.norm(part - mid[:, None], axis=2).max(axis=1)
            same = other.t[who]  # (piece, corner whose nearest triangle it is, corner of that triangle, axis)
            one = np.sqrt(_to_triangles(part[:, None], *(same[:, :, None, k] for k in range(3)))).max(axis=2).min(axis=1)
            keep.append((part, np.minimum(centre + radius, one)))
        t = np.concatenate([part[most > max(found + tolerance, bound or 0.0)] for part, most in keep])
        m = (t + np.roll(t, -1, axis=1)) / 2  # middles of ab, bc, ca
        a, b, c = t[:, 0], t[:, 1], t[:, 2]
        t = np.concatenate([np.stack(q, axis=1) for q in ((a, m[:, 0], m[:, 2]), (m[:, 0], b, m[:, 1]), (m[:, 2], m[:, 1], c), (m[:, 0], m[:, 1], m[:, 2]))])
    return found


MESH = f"{M} long, kind string, i long, a double, b double, c double, u double, v double"


def _rows(mesh_id, xyz: np.ndarray, faces: np.ndarray, uv: np.ndarray | None = None) -> pd.DataFrame:
    """Vertices (a, b, c are x, y, z) and faces (a, b, c are indices) of one mesh as rows."""
    none = np.full(len(xyz), np.nan)
    v = pd.DataFrame({M: mesh_id, "kind": "vertex", "i": np.arange(len(xyz)), "a": xyz[:, 0], "b": xyz[:, 1], "c": xyz[:, 2], "u": none if uv is None else uv[:, 0], "v": none if uv is None else uv[:, 1]})
    f = pd.DataFrame({M: mesh_id, "kind": "face", "i": np.arange(len(faces)), "a": faces[:, 0].astype(float), "b": faces[:, 1].astype(float), "c": faces[:, 2].astype(float), "u": np.nan, "v": np.nan})
    return pd.concat([v, f], ignore_index=True)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of rows as the functions below give them."""
    v = rows.where("kind = 'vertex'").selectExpr(M, "i as vid", "a as x", "b as y", "c as z", "u", "v")
    return v, rows.where("kind = 'face'").selectExpr(M, "i as fid", "cast(a as long) as a", "cast(b as long) as b", "cast(c as long) as c")


def joined(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertices and faces as rows of one table, for a group by mesh."""
    uv = ("u", "v") if "u" in vertices.columns else ("cast(null as double)", "cast(null as double)")
    v = vertices.selectExpr(f"cast({M} as long) {M}", "'vertex' as kind", "cast(vid as long) i", "x as a", "y as b", "z as c", f"{uv[0]} as u", f"{uv[1]} as v")
    return v.unionByName(faces.selectExpr(f"cast({M} as long) {M}", "'face' as kind", "cast(fid as long) i", "cast(a as double) a", "cast(b as double) b", "cast(c as double) c", "cast(null as double) u", "cast(null as double) v"))


def _parts(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v, f = pdf[pdf.kind == "vertex"].sort_values("i"), pdf[pdf.kind == "face"].sort_values("i")
    at = {int(k): i for i, k in enumerate(v.i)}
    return v[["a", "b", "c"]].to_numpy(), np.array([[at[int(x)] for x in t] for t in f[["a", "b", "c"]].to_numpy()], dtype=np.int64).reshape(-1, 3), v[["u", "v"]].to_numpy()


def delaunay_meshes(points: DataFrame) -> DataFrame:
    """Delaunay mesh of the points (mesh_id, x, y, z) of each mesh; `split` parts the result."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["x", "y", "z"])[["x", "y", "z"]].to_numpy()
        return _rows(pdf[M].iloc[0], p, delaunay(p[:, :2]))

    return points.selectExpr(f"cast({M} as long) {M}", "x", "y", "z").groupBy(M).applyInPandas(run, MESH)


def terra_meshes(pixels: DataFrame, max_error: float, max_points: int | None = None) -> DataFrame:
    """Greedy insertion mesh of each raster tile (mesh_id, row, col, z); x is the column and y counts rows from the south."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.full((int(pdf.row.max()) + 1, int(pdf.col.max()) + 1), np.nan)
        z[pdf.row, pdf.col] = pdf.z
        v, f = terra(z, max_error, max_points)
        return _rows(pdf[M].iloc[0], np.stack((v[:, 1], z.shape[0] - 1 - v[:, 0], v[:, 2]), axis=1), f)

    return pixels.selectExpr(f"cast({M} as long) {M}", "cast(row as int) row", "cast(col as int) col", "z").groupBy(M).applyInPandas(run, MESH)


def simplify_meshes(vertices: DataFrame, faces: DataFrame, ratio: float | None = 0.5, max_error: float | None = None, **conditions: float) -> DataFrame:
    """Each mesh simplified under the conditions of `simplify`; `split` parts the result."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, f, uv = _parts(pdf)
        mean = p.mean(axis=0)  # small numbers keep the quadrics exact
        p, f, uv = simplify(p - mean, f, ratio, max_error, None if np.isnan(uv).any() else uv, **conditions)
        return _rows(pdf[M].iloc[0], p + mean, f, uv)

    return joined(vertices, faces).groupBy(M).applyInPandas(run, MESH)


def uv_meshes(vertices: DataFrame, faces: DataFrame, weights: str = "conformal", border: str = "circle") -> DataFrame:
    """Each mesh with texture coordinates; `split` parts the result."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, f, _ = _parts(pdf)
        return _rows(pdf[M].iloc[0], p, f, uv_map(p, f, weights, border))

    return joined(vertices, faces).groupBy(M).applyInPandas(run, MESH)


def warp_textures(images: list[np.ndarray], source: np.ndarray, target: np.ndarray, owner: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Atlas of merged meshes: for each face the affine map from its corners in its own mesh's image to those in the atlas.

    images: (height, width, channels) of each mesh; source and target: (faces, 3, 2) texture coordinates, v upwards; owner: the
    image of each face.  Faces are grown by a hundredth about their middle so that no seam stays open; sampling is bilinear, and
    later faces paint over earlier ones."""
    h, w = size
    out = np.zeros((h, w, images[0].shape[2]))
    for src, dst, o in zip(source, target, owner, strict=True):
        img = images[o]
        to = lambda t, hh, ww: np.stack((t[:, 0] * (ww - 1), (1 - t[:, 1]) * (hh - 1)), axis=1)
        d, s = to(dst, h, w), to(src, *img.shape[:2])
        mid = d.mean(axis=0)
        grown = mid + (d - mid) * 1.01
        x0, y0 = np.maximum(np.floor(grown.min(axis=0)).astype(int), 0)
        x1, y1 = np.minimum(np.ceil(grown.max(axis=0)).astype(int), (w - 1, h - 1))
        m = np.array([d[1] - d[0], d[2] - d[0]]).T
        if x1 < x0 or y1 < y0 or abs(np.linalg.det(m)) < 1e-12:
            continue
        x, y = np.meshgrid(np.arange(x0, x1 + 1), np.arange(y0, y1 + 1))
        b = np.linalg.solve(m, np.stack((x.ravel() - d[0, 0], y.ravel() - d[0, 1])))
        e = 0.01
        inside = (b[0] >= -e) & (b[1] >= -e) & (b.sum(axis=0) <= 1 + e)
        p = s[0][:, None] + np.array([s[1] - s[0], s[2] - s[0]]).T @ b
        px, py = np.clip(p[0], 0, img.shape[1] - 1), np.clip(p[1], 0, img.shape[0] - 1)
        i, j = np.floor(py).astype(int), np.floor(px).astype(int)
        i1, j1 = np.minimum(i + 1, img.shape[0] - 1), np.minimum(j + 1, img.shape[1] - 1)
        fy, fx = (py - i)[:, None], (px - j)[:, None]
        v = img[i, j] * (1 - fy) * (1 - fx) + img[i, j1] * (1 - fy) * fx + img[i1, j] * fy * (1 - fx) + img[i1, j1] * fy * fx
        out[y.ravel()[inside], x.ravel()[inside]] = v[inside]
    return out
