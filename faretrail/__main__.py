"""``python -m faretrail journey|cards|survey ...`` (see plans/jobs.py)."""

from .plans.jobs import main

main()
