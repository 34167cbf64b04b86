"""What a site's stream keeps of the volume under way, and what a further chunk makes of it.

A chunk's radials are placed at once, by the rules of the window form: every elevation begins at
its first radial; it is open until its first closing one or, if that comes earlier, until the next
new elevation begins; what is outside is late. Of earlier chunks only the elevations seen so far
matter, and whether the last of them is still open.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions.codes import CLOSING


@dataclass
class Volume:
    """Fields are those of the stream's state, in its order."""

    epoch: int = 0
    events: int = 0  # of the site, so far
    under_way: bool = False
    arrival: int = 0  # of the last chunk, in ms
    seen: list[int] = field(default_factory=list)  # elevations, as they came
    is_open: bool = False  # the last of them
    taken: int = 0  # radials of the open one
    msg5: int | None = None
    rvol: int | None = None
    julian_date: int | None = None  # of the first radial, with the next field the volume's id
    scan_time_ms: int | None = None

    @property
    def vcp(self) -> int:
        return self.msg5 if self.msg5 is not None else self.rvol or 0

    def _begin(self, msg5: int | None = None) -> None:
        self.epoch += 1
        self.under_way, self.seen, self.is_open, self.taken = True, [], False, 0
        self.msg5, self.rvol, self.julian_date, self.scan_time_ms = msg5, None, None, None

    def _event(self, kind: str, **more) -> dict:
        self.events += 1
        return {"event_type": kind, "epoch": self.epoch, "event_no": self.events} | more

    def _swept(self, elevation: int, complete: bool, count: int, vcp: int) -> dict:
        return self._event("SweepClosed", elevation_number=elevation, complete=complete, count=count, vcp_number=vcp, **self._id())

    def _id(self) -> dict:
        return {"julian_date": self.julian_date or 0, "scan_time_ms": self.scan_time_ms or 0}

    def unreadable(self, error: str) -> list[dict]:
        """A chunk that cannot be read is told, and changes nothing."""
        return [self._event("Unreadable", status=error)]

    def close(self, status: str) -> list[dict]:
        """The volume ends: the sweep that is still open is reported, then the volume."""
        out = [self._swept(self.seen[-1], False, self.taken, self.vcp)] if self.is_open else []
        out.append(self._event("VolumeClosed", status=status, vcp_number=self.vcp, **self._id()))
        self.under_way = self.is_open = False
        return out

    def silent(self, now: int, timeout: int | None) -> bool:
        return self.under_way and timeout is not None and now - self.arrival >= timeout

    def take(self, kind: str, vcp: int | None, rays: np.ndarray, arrival: int = 0, timeout: int | None = None) -> list[dict]:
        """Events of one readable chunk. kind: S, I, E or RESET. rays: a row per radial in order, of
        elevation, status, VCP of its RVOL block (-1: none), julian_date and scan_time_ms."""
        out = self.close("TimedOut") if self.silent(arrival, timeout) else []
        self.arrival = arrival
        if kind == "RESET":
            self.under_way = self.is_open = False
            return [*out, self._event("RESET")]
        if kind == "S":
            if self.under_way and self.seen:
                out += self.close("Superseded")
            self._begin(vcp)
            return out
        if not self.under_way:
            self._begin()
            out.append(self._event("MissingStart"))
        if len(rays):
            out += self._place(rays)
        return out + self.close("Complete") if kind == "E" else out

    def _place(self, rays: np.ndarray) -> list[dict]:
        """One pass; a chunk has some ten to some hundred radials, too few for work by columns to pay."""
        out, late = [], {}
        for elevation, status, rvol, julian_date, scan_time_ms in rays.tolist():
            new = elevation not in self.seen
            if not new and not (self.is_open and elevation == self.seen[-1]):
                late[elevation] = late.get(elevation, 0) + 1
                continue
            if self.julian_date is None:
                self.julian_date, self.scan_time_ms = julian_date, scan_time_ms
            # the radial that closes a sweep counts, even if it is the next one's first
            if rvol >= 0:
                self.rvol = rvol
            if new:
                if self.is_open:
                    out.append(self._swept(self.seen[-1], False, self.taken, self.vcp))
                self.seen.append(elevation)
                self.is_open, self.taken = True, 0
            self.taken += 1
            if status in CLOSING:
                out.append(self._swept(elevation, True, self.taken, self.vcp))
                self.is_open = False
        return out + [self._event("LateRadialsDiscarded", elevation_number=e, count=n) for e, n in sorted(late.items())]
