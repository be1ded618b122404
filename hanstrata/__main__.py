from hanstrata.plans.commands import main

main()
