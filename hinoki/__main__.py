"""``python -m hinoki`` or ``spark-submit``: the command-line tools."""

from hinoki.plans.tools import main

main()
