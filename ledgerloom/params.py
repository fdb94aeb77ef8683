"""Protocol parameters that the jobs need, as literals or one row of data."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Fees, sizes and prices of the public protocol parameters.
    fee_per_byte: int = 44
    fee_fixed: int = 155_381
    max_tx_size: int = 16_384
    coins_per_byte: int = 4_310
    price_mem: tuple[int, int] = (577, 10_000)
    price_steps: tuple[int, int] = (721, 10_000_000)
    ref_script_per_byte: int = 44
    #: Script bytes from which the next tier begins, and the growth of the price from tier to tier.
    ref_script_tier: int = 25_600
    ref_script_growth: tuple[int, int] = (6, 5)
    collateral_percent: int = 150


DEFAULT = Params()
#: Units given to a redeemer before it is evaluated.
EVALUATION_MEM, EVALUATION_STEPS = 16_500_000, 10_000_000_000
