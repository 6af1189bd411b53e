"""Verification of Ed25519 signatures (RFC 8032) where there is no JVM: in Python workers.

Points are extended coordinates (X, Y, Z, T) on -x^2 + y^2 = 1 + d x^2 y^2 modulo P.
"""

from __future__ import annotations

import hashlib

# Fixed values of the standard.
P, ORDER = 2**255 - 19, 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT_OF_MINUS_ONE = pow(2, (P - 1) // 4, P)


def _x_of(y: int, odd: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(square, (P + 3) // 8, P)
    if x * x % P != square:
        x = x * ROOT_OF_MINUS_ONE % P
    if x * x % P != square or (x == 0 and odd):
        return None
    return P - x if x & 1 != odd else x


def _point(data: bytes) -> tuple[int, int, int, int] | None:
    n = int.from_bytes(data, "little")
    y = n & (1 << 255) - 1
    x = _x_of(y, n >> 255)
    return None if x is None else (x, y, 1, x * y % P)


def _sum(a: tuple, b: tuple) -> tuple:
    m, n = (a[1] - a[0]) * (b[1] - b[0]), (a[1] + a[0]) * (b[1] + b[0])
    t, z = 2 * a[3] * b[3] * D, 2 * a[2] * b[2]
    e, f, g, h = n - m, z - t, z + t, n + m
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(k: int, point: tuple) -> tuple:
    out = (0, 1, 1, 0)
    while k:
        if k & 1:
            out = _sum(out, point)
        point, k = _sum(point, point), k >> 1
    return out


_y = 4 * pow(5, P - 2, P) % P
_BASE_X = _x_of(_y, 0) or 0
BASE = (_BASE_X, _y, 1, _BASE_X * _y % P)


def verified(public: bytes, message: bytes, signature: bytes) -> bool:
    """Whether the signature is that of the message by the owner of the public key; False for malformed ones."""
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _point(public), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    h = int.from_bytes(hashlib.sha512(signature[:32] + public + message).digest(), "little") % ORDER
    left, right = _times(s, BASE), _sum(r, _times(h, a))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0
