import sys

from changelens.plans.cli import main

sys.exit(main())
