"""Latent vectors to colours: u_l, u_c and u_h of each slot, squashed into its domain."""

from __future__ import annotations

from collections.abc import Sequence
from types import SimpleNamespace

from ..config import CapLookup, require
from ..errors import InvalidProblem
from ..functions.color import oklab_to_linear, oklch_to_oklab, relative_luminance
from ..functions.numeric import sigmoid, smoothstep, wrap_float, wrap_hue
from .cap import Cap, lookup


def latent_dim(n_slots: int) -> int:
    return 3 * n_slots


def lightness_hue(slot, u_l, u_h, o) -> tuple:
    l = slot.lightness.min + sigmoid(u_l, o) * slot.lightness.span
    h = wrap_hue(u_h, o) if slot.hue is None else wrap_hue(wrap_float(slot.hue.start) + sigmoid(u_h, o) * slot.hue.length, o)
    return l, h


def cap_at(cap: Cap | None, l, h, mode: CapLookup, o):
    return None if cap is None else lookup(l, h, cap.n_l, cap.n_h, cap.l_min, cap.l_max, mode, o)


def chroma(slot, u_c, at, o) -> tuple:
    """The chroma, and the limit that the cap sets (None without)."""
    low, high, limit = slot.chroma.min, slot.chroma.max, None
    if slot.cap_policy == "hard":
        require(at is not None, "a hard cap policy requires a cap", InvalidProblem)
        # the cap binds even below the slot's own least chroma
        limit = high = o.minimum(high, at)
        low = o.minimum(low, limit)
    elif slot.cap_policy == "soft":
        limit = at
    return low + sigmoid(u_c, o) * o.maximum(high - low, 0.0), limit


def decode_slot(slot, u_l, u_c, u_h, cap: Cap | None, mode: CapLookup, o) -> SimpleNamespace:
    """l, c, h of one slot, and the cap at (l, h) with the limit it sets (None without)."""
    l, h = lightness_hue(slot, u_l, u_h, o)
    at = cap_at(cap, l, h, mode, o)
    c, limit = chroma(slot, u_c, at, o)
    return SimpleNamespace(l=l, c=c, h=h, cap_at=at, limit=limit)


def colour_of(slot, decoded: SimpleNamespace, o) -> SimpleNamespace:
    """`decoded` with a, b, relative luminance and the hue gate."""
    lab = oklch_to_oklab((decoded.l, decoded.c, decoded.h), o)
    gate = o.const(1.0) if slot.chroma_epsilon <= 0 else smoothstep(decoded.c / slot.chroma_epsilon, o)
    return SimpleNamespace(**vars(decoded), a=lab[1], b=lab[2], luminance=relative_luminance(oklab_to_linear(lab), o), gate=gate)


def decode_palette(slots: Sequence, latent: Sequence, cap: Cap | None, mode: CapLookup, o) -> list[SimpleNamespace]:
    """All slots of candidates whose latent values are latent[j]; for arrays each is one value per candidate."""
    require(len(latent) == latent_dim(len(slots)), f"latent length mismatch: expected {latent_dim(len(slots))}, got {len(latent)}", InvalidProblem)
    return [colour_of(s, decode_slot(s, *latent[3 * i : 3 * i + 3], cap, mode, o), o) for i, s in enumerate(slots)]
