from .plans.cli import main

main()
