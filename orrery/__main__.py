import sys

from .lang.shell import main

sys.exit(main(sys.argv[1:]))
