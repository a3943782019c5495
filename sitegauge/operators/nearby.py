"""Sums over the points near a site, for the sites and points of one tile: numpy inside the tasks of a co-group.

Distances are chords between unit vectors. Pairs whose chord does not settle them (nearly equal positions, or a distance that
rounding could move across the limit) are decided by the haversine formula, as everywhere else.
"""

from __future__ import annotations

import math

import numpy as np

from sitegauge.functions.scalar import EARTH_RADIUS_KM

PAIRS_AT_ONCE = 1 << 17     # elements of a matrix that stay in a core's cache
SLACK = 1e-7                # of the unit sphere: more than rounding does to a chord
DOUBT = 1e-9                # of the squared chord at the limit
CLOSE = 1e-8                # squared chords below (some 600 m) lose digits in a product of matrices
SERIES_UP_TO = 1e-3         # squared half chord (400 km) up to which four terms give all digits


def unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)


def haversine_km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    half_lat, half_lon = np.radians(lat2 - lat1) / 2, np.radians(lon2 - lon1) / 2
    a = np.sin(half_lat) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(half_lon) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1.0, a)))


def chord(km: float) -> float:
    return 2 * math.sin(min(km / (2 * EARTH_RADIUS_KM), math.pi / 2))


def _leaves(lat: np.ndarray, lon: np.ndarray, size: int) -> np.ndarray:
    """Positions of the points in leaves of ``size`` neighbours: strips of latitude, cut along the longitude. The last point fills up."""
    n = len(lat)
    per_strip = size * math.ceil(n / (size * max(1, round(math.sqrt(n / size)))))
    strip = np.empty(n, dtype=np.int64)
    strip[np.argsort(lat, kind="stable")] = np.arange(n) // per_strip
    order = np.lexsort((lon, strip))
    return np.concatenate([order, np.repeat(order[-1], -n % size)]).reshape(-1, size)


def count(slat: np.ndarray, slon: np.ndarray, plat: np.ndarray, plon: np.ndarray, weight: np.ndarray, km: float, leaf: int) -> np.ndarray:
    """Weight of the points within ``km`` of each site. Leaves wholly inside the circle add their weight; only those on its edge are opened."""
    index = _leaves(plat, plon, leaf)
    held = weight[index]
    held.reshape(-1)[len(plat):] = 0
    spots = unit(plat, plon)[index]
    middle = spots.mean(axis=1)
    radius = np.sqrt(((spots - middle[:, None]) ** 2).sum(axis=2).max(axis=1))
    limit, total = chord(km), held.sum(axis=1)
    out = np.zeros(len(slat), dtype=np.int64)
    step = max(1, PAIRS_AT_ONCE // len(index))
    for first in range(0, len(slat), step):
        part = slice(first, first + step)
        at = unit(slat[part], slon[part])
        away = np.sqrt(np.maximum(0.0, 1.0 + (middle ** 2).sum(axis=1) - 2 * (at @ middle.T)))
        inside = away + radius <= limit - SLACK
        out[part] = inside @ total
        site, met = np.nonzero((away - radius <= limit + SLACK) & ~inside)
        for k in range(0, len(site), PAIRS_AT_ONCE // leaf):
            s, m = site[k:k + PAIRS_AT_ONCE // leaf], met[k:k + PAIRS_AT_ONCE // leaf]
            gap = spots[m]
            gap -= at[s][:, None]
            squared = np.einsum("ijk,ijk->ij", gap, gap)
            hit = squared <= limit * limit
            i, j = np.nonzero(np.abs(squared - limit * limit) <= DOUBT * limit * limit)
            if len(i):
                point = index[m[i], j]
                hit[i, j] = haversine_km(slat[part][s[i]], slon[part][s[i]], plat[point], plon[point]) <= km
            np.add.at(out, first + s, (hit * held[m]).sum(axis=1))
    return out


def _squared_angle(q: np.ndarray, largest: float) -> np.ndarray:
    """Square of half the angle, from the square of half the chord."""
    if largest <= SERIES_UP_TO:
        return q * (1 + q * (1 / 3 + q * (8 / 45 + q * (4 / 35))))
    return np.arcsin(np.sqrt(np.clip(q, 0.0, 1.0))) ** 2


def inverse_square_sums(slat: np.ndarray, slon: np.ndarray, plat: np.ndarray, plon: np.ndarray, values: np.ndarray, km: float) -> tuple[np.ndarray, np.ndarray]:
    """For each site the sums of ``values`` (a row for each point) at its own position, and those of values / km^2 over the others within ``km``."""
    spots = unit(plat, plon)
    origin = spots.mean(axis=0)
    spots -= origin
    right = np.concatenate([spots, np.ones((len(spots), 1)), (spots ** 2).sum(axis=1, keepdims=True)], axis=1).T
    limit, scale = chord(km) ** 2, (2 * EARTH_RADIUS_KM) ** 2
    odd = ~np.isfinite(values).all(axis=1)      # a NaN times nothing is NaN: only the sites near it may see it
    plain = np.where(odd[:, None], 0.0, values)
    here, away = np.zeros((len(slat), values.shape[1])), np.zeros((len(slat), values.shape[1]))
    step = max(1, PAIRS_AT_ONCE // len(plat))
    for first in range(0, len(slat), step):
        part = slice(first, first + step)
        at = unit(slat[part], slon[part]) - origin
        left = np.concatenate([-2 * at, (at ** 2).sum(axis=1, keepdims=True), np.ones((len(at), 1))], axis=1)
        squared = left @ right
        sure = (squared >= CLOSE) & (squared < limit * (1 - DOUBT)) & ~odd
        i, j = np.nonzero((squared <= limit * (1 + DOUBT)) & ~sure)
        squared *= 0.25
        squared[~sure] = 1.0
        share = sure / _squared_angle(squared, limit / 4)
        away[part] = (share @ plain) / scale
        if len(i):
            d = haversine_km(slat[part][i], slon[part][i], plat[j], plon[j])
            np.add.at(here, first + i[d == 0], values[j[d == 0]])
            off = (d > 0) & (d <= km)
            np.add.at(away, first + i[off], values[j[off]] / (d[off] ** 2)[:, None])
    return here, away
