"""The nine histogram layouts."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """precision: bits of a code's precision field; a code has 6 more (5 more in n-D Fast layouts, whose magnitude has 3 bits).

    Fixed values: name, number of axes, precision bits, wire byte, registered bit length.
    """

    name: str
    dims: int
    precision: int
    wire: int
    registered_bits: int

    @property
    def fast_nd(self) -> bool:
        return self.dims > 1 and self.name.endswith("F")

    @property
    def bits(self) -> int:
        """Bits of an axis's code with its sign and exponent sign."""
        return self.precision + (5 if self.fast_nd else 6)

    @property
    def queryable(self) -> bool:
        return not self.fast_nd


CONFIGS = {
    c.name: c
    for c in (
        Config("1DxT", 1, 7, 0x00, 13),
        Config("1DxF", 1, 10, 0x01, 16),
        Config("1DxP", 1, 14, 0x02, 20),
        Config("2DxF", 2, 5, 0x10, 10),
        Config("2DxP", 2, 6, 0x11, 12),
        Config("3DxF", 3, 5, 0x20, 10),
        Config("3DxP", 3, 6, 0x21, 12),
        Config("4DxF", 4, 5, 0x30, 10),
        Config("4DxP", 4, 6, 0x31, 12),
    )
}
BY_WIRE = {c.wire: c for c in CONFIGS.values()}


def config(name: str | Config) -> Config:
    """The layout of that name, such as 1DxP."""
    if isinstance(name, Config):
        return name
    if name not in CONFIGS:
        raise ValueError(f"unknown layout {name!r}; there are {', '.join(CONFIGS)}")
    return CONFIGS[name]


def for_kind(dims: int, letter: str) -> Config:
    """The layout for a number of axes and a letter T, F or P; T is for one axis only."""
    return config(f"{dims}Dx{letter}")
