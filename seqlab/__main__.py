from seqlab.plans.commands import main

main()
