"""Imports every module that registers queries."""

import checks.features  # noqa: F401
import checks.tables  # noqa: F401
import checks.metrics  # noqa: F401
import checks.trajectories  # noqa: F401
import checks.audit  # noqa: F401
import checks.review  # noqa: F401
import checks.resampling  # noqa: F401
import checks.calibration  # noqa: F401
import checks.learning  # noqa: F401
import checks.streaming  # noqa: F401
import checks.sinks  # noqa: F401
