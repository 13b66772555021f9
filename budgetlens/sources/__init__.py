"""budgetlens.sources"""
