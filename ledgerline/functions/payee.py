"""Who is paid: the words and numbers by which narratives name the payee. A parameter of parsing, not part of its rules."""

from __future__ import annotations

import re
from dataclasses import dataclass


# A joint-stock company in full and cut short, and its trade (water supply), in folded words.
FULL, SHORT, TRADE = "cong ty co phan", ("ctcp", "ct cp"), "cap nuoc"


@dataclass(frozen=True)
class Payee:
    """A water company: its city, own short names and own accounts, all in folded form."""

    city: str = "hue"
    brands: tuple[str, ...] = ()
    accounts: tuple[str, ...] = ()

    @property
    def receiver(self) -> str:
        """Pattern of a receiver's name in folded words that is this payee; another city's company is not."""
        city = re.escape(self.city)
        return r"\b(?:" + "|".join([rf"{city}\s+water", r"water\s+supply", rf"cap\s+nuoc\s+{city}", *map(re.escape, self.brands)]) + r")\b"

    @property
    def company(self) -> str:
        """Pattern of the company's own name: in full with its city, or with the kind of company cut short."""
        city = re.escape(self.city)
        return rf"\b(?:{FULL} {TRADE} {city}|(?:{'|'.join(SHORT)}) {TRADE}(?: {city})?)\b"

    @property
    def purpose(self) -> str:
        """Pattern of words that tell a payment for water."""
        return r"\b(?:" + "|".join([r"tien\s*nuoc", "nuoc", "water", "tthd", *map(re.escape, self.brands)]) + r")\b|nuoc(?=\d)"


DEFAULT = Payee()
