"""Feature layouts of landmark frames.

A native frame is ``[pose | left hand | right hand]``, a source frame is the two
hand blocks alone, and a model frame is a source frame with trailing zeros up to
the native width.  All widths follow from the point counts.
"""

from dataclasses import dataclass

# Fixed values of the full-body layout and of the clip length models expect.
TARGET_LENGTH = 64
COORDINATES = 3
MISSING_ATOL = 1e-8
MIN_SCALE = 1e-6


@dataclass(frozen=True)
class Layout:
    pose_points: int = 33
    hand_points: int = 21
    left_shoulder: int = 11
    right_shoulder: int = 12

    @property
    def points(self) -> int:
        return self.pose_points + 2 * self.hand_points

    @property
    def width(self) -> int:
        return self.points * COORDINATES

    @property
    def hand_width(self) -> int:
        return self.hand_points * COORDINATES

    @property
    def source_width(self) -> int:
        return 2 * self.hand_width

    @property
    def pose_width(self) -> int:
        return self.pose_points * COORDINATES

    @property
    def padding(self) -> int:
        return self.width - self.source_width

    def blocks(self) -> dict[str, tuple[int, int]]:
        """name -> (first point, point count)."""
        return {
            "pose": (0, self.pose_points),
            "left_hand": (self.pose_points, self.hand_points),
            "right_hand": (self.pose_points + self.hand_points, self.hand_points),
        }


FULL_BODY = Layout()
